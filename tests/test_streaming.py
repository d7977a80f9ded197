from convprep.operators.chats import messages_of
from convprep.operators.samples import chat_samples
from convprep.profiles import PLAIN
from convprep.sources.writers import write_chat_jsonl
from convprep.streaming.samples import stream_chats, write_samples


def test_stream_gives_the_batch_samples_once(spark, chats, tmp_path):
    first = chats([("User", "a"), ("Chatbot", "b"), ("User", "c"), ("Chatbot", "d")], [("User", "x")])
    second = chats([("User", "e"), ("Chatbot", "f")])
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        query = write_samples(stream_chats(spark, folder + "/*"), out, checkpoint, PLAIN, 100)
        query.awaitTermination()

    columns = ["turn", "first_turn", "n_tokens", "prompt", "completion"]
    for i, batch in enumerate((first, second)):
        write_chat_jsonl(batch, f"{folder}/{i}")
        run()
    want = chat_samples(first, PLAIN, 100).unionByName(chat_samples(second, PLAIN, 100))
    got = spark.read.parquet(out)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert messages_of(first).count() == 5
