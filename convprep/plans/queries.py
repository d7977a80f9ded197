"""Every operator as a query over the given tables: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convprep.functions.messages import (
    CHATBOT,
    SYSTEM,
    USER,
    body_of,
    normalize_role,
    preamble_of,
)
from convprep.functions.rendering import base_cost, render_messages, strip_begin, template_text, training_text
from convprep.functions.tokens import WordCounter, length_bucket, rendered_tokens
from convprep.operators.chats import BLOCK, chat_table, message_table, messages_of, pairs_to_chats
from convprep.operators import dictionary
from convprep.operators.compact import compact_samples, rendered
from convprep.operators.dedupe import cast_declared, chat_facts, dedupe_chats, dedupe_rows, first_chats
from convprep.operators.inference import batch_generate, extract_replies, request_prompts
from convprep.operators.lengths import choose_length, sample_tokens
from convprep.operators.report import Funnel, funnel, preview, split_sizes
from convprep.operators.running import block_of
from convprep.operators.samples import EXACT, REFERENCE
from convprep.operators.seen import SeenChats
from convprep.operators.split import split_exact, split_ordered
from convprep.operators.tensors import label_mask, pack, with_special, word_ids
from convprep.operators.turns import message_costs, message_turns, preamble_rows, turn_facts, turn_verdicts
from convprep.plans.session import scratch_path, shuffles_freed, stored
from convprep.plans.files import prepare
from convprep.plans.rows import dropped_rows, training_rows
from convprep.plans.training import training_samples, training_set, training_sets
from convprep.profiles import (
    CONTROL_TOKENS,
    MARKED,
    PLAIN,
    SECTIONED,
    TURN_END,
    Profile,
    profile_columns,
    with_profile,
)
from convprep.sources import detect, readers, writers

Query = Callable[[SparkSession, str], DataFrame]

# Added to the ids of a second copy of the chats.
COPY = 1_000_000_000
# Records of a packed CSV file.
FILE_RECORDS = 1 << 15

CUSTOM = Profile(
    "brackets",
    prefix="",
    system_open="[sys] ",
    user_open="[ask] ",
    chatbot_open="[reply] ",
    close=" [end]\n",
    suffix="[reply] ",
    last_prompt_token="[reply]",
    prefix_tokens=0,
    frame_tokens=2,
)

DEFECTS = ["as_is", "users_as_system", "unknown_role", "sides_swapped", "no_content"]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    return message_table(_table(spark, folder, "conversations"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as pairs: the first line asks, the rest answers."""
    text = F.col("text")
    first = F.substring_index(text, "\n", 1)
    return _table(spark, folder, "documents").select(
        "doc_id",
        first.alias("prompt"),
        F.substring(text, F.length(first) + 2, F.length(text)).alias("completion"),
    )


def _twice(messages: DataFrame) -> DataFrame:
    """All chats and a full copy of them under other ids."""
    ids = F.explode(F.array(F.col("chat_id"), F.col("chat_id") + COPY))
    return messages.withColumn("chat_id", ids)


def _with_defects(messages: DataFrame) -> DataFrame:
    """Every chat once as it is and once with each kind of defect."""
    role = F.col("role")
    swapped = F.when(role == USER, CHATBOT).when(role == CHATBOT, USER).otherwise(role)
    return (
        messages.withColumn("defect", F.explode(F.array(*[F.lit(d) for d in DEFECTS])))
        .withColumn(
            "role",
            F.when((F.col("defect") == "users_as_system") & (role == USER), SYSTEM)
            .when((F.col("defect") == "unknown_role") & (role == CHATBOT), "Assistant")
            .when(F.col("defect") == "sides_swapped", swapped)
            .otherwise(role),
        )
        .withColumn(
            "content",
            F.when((F.col("defect") == "no_content") & (F.col("pos") == 0), F.lit(None)).otherwise(F.col("content")),
        )
        .withColumn("chat_id", F.concat_ws(":", "defect", "chat_id"))
    )


def normalize_roles(spark, folder):
    rows = _table(spark, folder, "conversations")
    return rows.select("conv_id", "turn", normalize_role(F.upper("role")).alias("role"), "text")


def pc_to_chat(spark, folder):
    return messages_of(pairs_to_chats(_pairs(spark, folder), "doc_id"))


def chat_validity(spark, folder):
    return chat_facts(_with_defects(_messages(spark, folder))).select("chat_id", "n_messages", "valid")


def inference_validity(spark, folder):
    """Chats as requests, once as they end and once without their last message."""
    messages = _messages(spark, folder)
    lasts = messages.groupBy("chat_id").agg(F.max("pos").alias("last"))
    # One row per chat and block of messages, so the join has no hot key.
    spread = lasts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), block_of("last", BLOCK))))
    ended = messages.withColumn("block", block_of("pos", BLOCK)).join(spread, ["chat_id", "block"])
    cut = ended.withColumn("dropped", F.explode(F.array(F.lit(0), F.lit(1))))
    kept = cut.filter(F.col("pos") <= F.col("last") - F.col("dropped")).select(
        F.struct("chat_id", "dropped").alias("chat_id"), "pos", "role", "content"
    )
    return chat_facts(kept).select(
        "chat_id.chat_id", "chat_id.dropped", F.col("valid_request").alias("valid")
    )


def chat_dedupe(spark, folder):
    return first_chats(chat_facts(_twice(_messages(spark, folder))))


def chat_row_dedupe(spark, folder):
    """The same for chats that are rows already: document pairs, many of them repeated."""
    chats = pairs_to_chats(_pairs(spark, folder), "doc_id")
    return messages_of(dedupe_chats(chats))


def row_dedupe(spark, folder):
    declared = {"prompt": "string", "completion": "string", "label": "string"}
    return dedupe_rows(cast_declared(_pairs(spark, folder), declared))


def funnel_report(spark, folder):
    messages = _messages(spark, folder)
    swapped = _with_defects(messages).select("chat_id", "pos", "role", "content")
    copied = _twice(messages).withColumn("chat_id", F.col("chat_id").cast("string"))
    return funnel(chat_facts(copied.unionByName(swapped)))


def split_exact_query(spark, folder):
    unique = first_chats(chat_facts(_twice(_messages(spark, folder))))
    return split_exact(unique, 0.2).select("chat_id", "split")


def split_report(spark, folder):
    messages = _messages(spark, folder)
    return split_sizes(split_exact(first_chats(chat_facts(messages)), 0.29))


def split_ordered_query(spark, folder):
    return split_ordered(_table(spark, folder, "documents").select("doc_id"), 0.8, "doc_id")


def turns(spark, folder):
    facts = turn_facts(message_turns(_messages(spark, folder)), ["chat_id", "turn"])
    return facts.filter((F.col("turn") >= 0) & F.col("end_pos").isNotNull()).select(
        "chat_id", "turn", "first_pos", "end_pos", "n_messages", "users", "systems"
    )


def _turn_costs(spark, folder, profile):
    numbered = message_turns(message_costs(_messages(spark, folder), profile))
    facts = turn_facts(numbered, ["chat_id", "turn"])
    return facts.filter((F.col("turn") >= 0) & F.col("end_pos").isNotNull()).select("chat_id", "turn", "cost")


def turn_cost(spark, folder):
    costs = [
        _turn_costs(spark, folder, p).withColumn("profile", F.lit(p.name)) for p in (PLAIN, MARKED)
    ]
    return costs[0].unionByName(costs[1])


def preamble_cost(spark, folder):
    """Tokens of a prompt without turns, in every profile; most chats have no preamble."""
    firsts = preamble_rows(_messages(spark, folder)).withColumn(
        "name", F.explode(F.array(*[F.lit(p.name) for p in (PLAIN, SECTIONED, MARKED)]))
    )
    p = profile_columns(F.col("profile"))
    return with_profile(firsts, "name").select(
        "chat_id",
        F.col("name").alias("profile"),
        (F.col("role") == SYSTEM).alias("has_preamble"),
        base_cost(p, WordCounter(), F.col("preamble")).cast("long").alias("base"),
    )


def raw_string_tokens(spark, folder):
    """The four endings a rendered string can have."""
    chats = chat_table(_messages(spark, folder))
    render = lambda profile: render_messages(
        profile_columns(profile), preamble_of(F.col("messages")), body_of(F.col("messages"))
    )
    plain, marked = render(PLAIN), render(MARKED)
    closed = F.regexp_replace(plain, r"<\|START_OF_TURN_TOKEN\|><\|CHATBOT_TOKEN\|>$", "")
    raw = F.concat(strip_begin(plain), F.lit("ok"))
    kinds = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), text.alias("text"))
            for kind, text in (("cue", plain), ("marked_cue", marked), ("closed", closed), ("raw", raw))
        ]
    )
    return chats.select("chat_id", F.inline(kinds)).select(
        "chat_id", "kind", rendered_tokens(F.col("text")).cast("long").alias("n_tokens")
    )


def overlong_drop(spark, folder):
    """Every chat as it is and with all its texts blank, which leaves empty turns."""
    kinds = F.explode(F.array(F.lit("as_is"), F.lit("blank")))
    messages = _messages(spark, folder).withColumn("kind", kinds)
    messages = messages.withColumn("chat_id", F.concat_ws(":", "kind", "chat_id")).withColumn(
        "content", F.when(F.col("kind") == "blank", "").otherwise(F.col("content"))
    )
    return turn_verdicts(messages.drop("kind"), SECTIONED, 128)


def _fit(spark, folder, mode):
    samples = training_samples(_messages(spark, folder), MARKED, 250, mode)
    return samples.select("chat_id", "turn", "first_turn", "n_tokens")


def budget_fit_exact(spark, folder):
    return _fit(spark, folder, EXACT)


def budget_fit_reference(spark, folder):
    return _fit(spark, folder, REFERENCE)


def _render(profile: Profile) -> Query:
    def query(spark, folder):
        chats = chat_table(_messages(spark, folder)).withColumn("name", F.lit(profile.name))
        rows = with_profile(chats, "name", [PLAIN, SECTIONED, MARKED, CUSTOM])
        p = profile_columns(F.col("profile"))
        text = render_messages(p, preamble_of(F.col("messages")), body_of(F.col("messages")))
        return rows.select("chat_id", text.alias("rendered"), strip_begin(text).alias("prompt"))

    return query


def training_samples_query(spark, folder):
    return training_samples(_messages(spark, folder), SECTIONED, 512)


def training_set_query(spark, folder):
    return training_set(_twice(_messages(spark, folder)), 0.2, SECTIONED, 512)


def separate_eval(spark, folder):
    """Conversations to train on, document pairs to evaluate on."""
    pairs = messages_of(pairs_to_chats(_pairs(spark, folder), "doc_id"))
    return training_sets(_messages(spark, folder), pairs, profile=PLAIN, budget=1024)


def training_text_query(spark, folder):
    samples = training_samples(_messages(spark, folder), SECTIONED, 512)
    padded = samples.withColumn("prompt", F.concat("prompt", F.lit("  "))).withColumn(
        "completion", F.concat(F.lit("  "), F.col("completion"), F.lit(" "))
    )
    return padded.select("chat_id", "turn", training_text(F.col("prompt"), F.col("completion")).alias("text"))


def length_bucket_query(spark, folder):
    lengths = choose_length(training_set(_messages(spark, folder), 0.2, SECTIONED))
    return lengths.select(*[F.col(c).cast("long").alias(c) for c in lengths.columns])


def sample_buckets(spark, folder):
    samples = training_samples(_messages(spark, folder), MARKED)
    n = sample_tokens(F.col("prompt"), F.col("completion"))
    return samples.select("chat_id", "turn", n.cast("long").alias("n_tokens")).withColumn(
        "bucket", length_bucket(F.col("n_tokens")).cast("long")
    )


def sample_preview(spark, folder):
    return preview(training_samples(_messages(spark, folder), SECTIONED, 512))


def chat_template_text(spark, folder):
    chats = chat_table(_messages(spark, folder))
    return chats.select(
        template_text(
            profile_columns(PLAIN), preamble_of(F.col("messages")), body_of(F.col("messages"))
        ).alias("text")
    )


def _requests(spark, folder):
    """Conversations as requests: the last user message asks, what precedes is history."""
    chats = chat_table(_messages(spark, folder))
    body = body_of(F.col("messages"))
    with_body = chats.select("chat_id", preamble_of(F.col("messages")).alias("preamble"), body.alias("_body"))
    asks = F.filter(
        F.transform("_body", lambda m, i: F.when(m["role"] == USER, i)), lambda i: i.isNotNull()
    )
    at = with_body.withColumn("_at", F.array_max(asks))
    return at.select(
        F.col("chat_id").alias("req_id"),
        "preamble",
        F.slice("_body", F.lit(1), F.coalesce("_at", F.lit(0))).alias("chat_history"),
        F.get(F.col("_body"), F.col("_at"))["content"].alias("message"),
    )


def inference_prompts(spark, folder):
    return request_prompts(_requests(spark, folder), MARKED).select("req_id", "prompt", "problem")


def reply_extract(spark, folder):
    """Each prompt with a whole generation, a cut-off one, and one for another prompt."""
    prompts = request_prompts(_requests(spark, folder), PLAIN).filter(F.col("prompt").isNotNull())
    whole = F.concat("prompt", F.lit("An answer, "), F.col("message"), F.lit(TURN_END))
    kinds = F.array(
        F.struct(F.lit("whole").alias("kind"), whole.alias("decoded")),
        F.struct(F.lit("cut").alias("kind"), F.concat("prompt", F.lit("An ans")).alias("decoded")),
        F.struct(F.lit("other").alias("kind"), F.lit("x" + TURN_END).alias("decoded")),
    )
    rows = prompts.select("req_id", "prompt", F.inline(kinds))
    return extract_replies(rows).select("req_id", "kind", "text", "problem")


def _count_characters(prompts: list[str]) -> list[str]:
    return [f"{p}{len(p)} characters{TURN_END}" for p in prompts]


def batch_generate_query(spark, folder):
    prompts = request_prompts(_requests(spark, folder), PLAIN).filter(F.col("prompt").isNotNull())
    return extract_replies(batch_generate(prompts, _count_characters)).select("req_id", "text", "problem")


def prepare_folders(spark, folder):
    """Chat files to train on, each chat twice, and pair files to evaluate on."""
    base = scratch_path(spark, "folders")
    writers.write_chat_jsonl(chat_table(_twice(_messages(spark, folder))), f"{base}/train")
    _pairs(spark, folder).select("prompt", "completion").write.options(**writers.CSV_WRITE).csv(f"{base}/eval")
    return prepare(spark, f"{base}/train", f"{base}/eval", profile=PLAIN, budget=1024).drop("chat_id")


def gapped_positions(spark, folder):
    """Samples of chats whose positions begin at 5 and have gaps."""
    spread = _messages(spark, folder).withColumn("pos", F.col("pos") * 700 + 5)
    return training_set(spread, 0.2, SECTIONED, 512)


def prepare_folders_split(spark, folder):
    """Chat files without an evaluation folder, split by what the chats say."""
    base = scratch_path(spark, "folder")
    writers.write_chat_jsonl(chat_table(_twice(_messages(spark, folder))), f"{base}/train")
    rows = prepare(spark, f"{base}/train", eval_fraction=0.2, profile=SECTIONED, budget=512)
    return rows.select("chat_id", "turn", "split", "prompt", "completion")


def packed_file_samples(spark, folder):
    """Blocks of the samples of a file folder, whose chats have digests as ids."""
    base = scratch_path(spark, "folder")
    writers.write_chat_jsonl(chat_table(_messages(spark, folder)), f"{base}/train")
    samples = prepare(spark, f"{base}/train", eval_fraction=0.2, profile=SECTIONED, budget=512)
    ids = with_special(word_ids(training_text(F.col("prompt"), F.col("completion"))))
    table = samples.select("chat_id", "turn", ids.alias("ids")).withColumn("n_ids", F.size("ids"))
    blocks = pack(stored(table, "token-ids"), 256, shards=8)
    return blocks.select(
        "shard", "block", F.size("ids").cast("long").alias("n_ids"), F.array_join("ids", " ").alias("ids")
    )


def csv_round_trip(spark, folder):
    path = scratch_path(spark, "samples-csv")
    writers.write_samples_csv(_pairs(spark, folder), path)
    return readers.accepted(readers.read_prepared_csv(spark, path)).select("prompt", "completion")


def jsonl_round_trip(spark, folder):
    path = scratch_path(spark, "chat-jsonl")
    writers.write_chat_jsonl(chat_table(_messages(spark, folder)), path)
    chats = readers.accepted(readers.read_chat_jsonl(spark, path))
    return chats.select(F.posexplode("messages").alias("pos", "m")).select(
        F.col("pos").cast("long").alias("pos"), "m.role", "m.content"
    )


def pc_jsonl_round_trip(spark, folder):
    path = scratch_path(spark, "pair-jsonl")
    writers.write_table(_pairs(spark, folder), path, "jsonl")
    return readers.accepted(readers.read_pair_jsonl(spark, path)).select("prompt", "completion")


def pair_csv_round_trip(spark, folder):
    path = scratch_path(spark, "pair-csv")
    pairs = _pairs(spark, folder).select("prompt", "completion")
    pairs.write.options(**writers.CSV_WRITE).csv(path)
    chats = readers.accepted(readers.pairs_as_chats(readers.read_pair_csv(spark, path)))
    return chats.select(
        F.get("messages", F.lit(0))["content"].alias("prompt"),
        F.get("messages", F.lit(1))["content"].alias("completion"),
    )


def csv_split_ranges(spark, folder):
    """Files of all pairs, whose quoted line ends and marks lie across the borders of many small input splits."""
    path = scratch_path(spark, "marked-csv")
    marked = F.concat("completion", F.lit('\n"quoted",\r\n"" end'))
    pairs = _pairs(spark, folder).select("prompt", marked.alias("completion"))
    pairs.write.options(**writers.CSV_WRITE).csv(path, header=True)
    small = spark.newSession()
    small.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    return readers.accepted(readers.read_prepared_csv(small, path)).select("prompt", "completion")


def split_parquet_round_trip(spark, folder):
    path = scratch_path(spark, "splits")
    samples = training_set(_messages(spark, folder), 0.2, SECTIONED, 512)
    text = training_text(F.col("prompt"), F.col("completion"))
    writers.write_splits(samples.select("prompt", "completion", text.alias("text"), "split"), path)
    return writers.read_splits(spark, path)


def table_formats(spark, folder):
    part = _table(spark, folder, "part")
    schema = part.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    out = None
    for fmt in ("csv", "tsv", "json", "jsonl"):
        path = scratch_path(spark, f"part-{fmt}")
        writers.write_table(part, path, fmt)
        rows = readers.read_table(spark, path, fmt, schema).withColumn("format", F.lit(fmt))
        out = rows if out is None else out.unionByName(rows)
    path = scratch_path(spark, "part-txt")
    writers.write_table(part.select("p_name"), path, "txt")
    lines = readers.read_table(spark, path, "txt").select(
        F.lit("txt").alias("format"), F.col("value").alias("p_name")
    )
    return out.unionByName(lines, allowMissingColumns=True)


def _bad_bytes_file(spark, folder) -> str:
    """Every pair once clean, once more, and once with a byte that is not UTF-8."""
    path = scratch_path(spark, "bad-bytes")
    # Written as ISO-8859-1, the characters below become the wanted bytes.
    as_bytes = lambda c: F.decode(F.encode(F.col(c), "UTF-8"), "ISO-8859-1")
    tail = F.explode(F.array(F.lit(""), F.lit(""), F.lit("\u00ff")))
    pairs = _pairs(spark, folder).select("prompt", "completion", tail.alias("tail"))
    pairs.select(
        as_bytes("prompt").alias("prompt"), F.concat(as_bytes("completion"), F.col("tail")).alias("completion")
    ).write.options(**writers.CSV_WRITE).option("encoding", "ISO-8859-1").csv(path, header=True)
    return path


def utf8_drop(spark, folder):
    kept = readers.accepted(readers.read_prepared_csv(spark, _bad_bytes_file(spark, folder)))
    return kept.select("prompt", "completion")


def utf8_drop_report(spark, folder):
    return dropped_rows(spark, _bad_bytes_file(spark, folder))


def _pairs_twice_and_bad(spark, folder, packed=False):
    """CSV files with every pair twice and once more with bytes that are no text, in order; ``packed`` with gzip.

    One task reads a whole packed file, so these are kept small.
    """
    path = scratch_path(spark, "pairs-csv")
    as_bytes = lambda c: F.decode(F.encode(F.col(c), "UTF-8"), "ISO-8859-1")
    tail = F.explode(F.array(F.lit(""), F.lit(""), F.lit("\u00ff")))
    # The copies are made where they are written, so each text is shuffled once.
    ordered = _pairs(spark, folder).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    out = ordered.select(as_bytes("prompt").alias("prompt"), as_bytes("completion").alias("completion"), tail.alias("tail"))
    files = out.select("prompt", F.concat("completion", "tail").alias("completion")).write.options(**writers.CSV_WRITE)
    if packed:
        files = files.option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS)
    with shuffles_freed(spark):
        files.option("encoding", "ISO-8859-1").csv(path, header=True)
    return path


def training_rows_query(spark, folder):
    """The first 0.8 of the distinct readable pairs of one file, in its order, are to train on."""
    return training_rows(spark, _pairs_twice_and_bad(spark, folder))


def funnel_full(spark, folder):
    """What became of the records of CSV files and of the chats of a folder, counted while they were prepared."""
    rows, chats = Funnel(), Funnel()
    # As they are, the files would be larger than all else on disk.
    training_rows(spark, _pairs_twice_and_bad(spark, folder, packed=True), funnel=rows)
    base = scratch_path(spark, "folder")
    written = _twice(_messages(spark, folder)).withColumn("chat_id", F.col("chat_id").cast("string"))
    defects = _with_defects(_messages(spark, folder)).select("chat_id", "pos", "role", "content")
    with shuffles_freed(spark):
        writers.write_chat_jsonl(chat_table(written.unionByName(defects)), f"{base}/train")
    prepare(spark, f"{base}/train", eval_fraction=0.2, profile=SECTIONED, budget=512, funnel=chats)
    reports = [f.report(spark).select(F.lit(name).alias("kind"), "stage", "n") for name, f in (("rows", rows), ("chats", chats))]
    return reports[0].unionByName(reports[1])


def format_detect(spark, folder):
    """One folder per format, found out and read back as chats."""
    base = scratch_path(spark, "formats")
    pairs = _pairs(spark, folder).select("prompt", "completion")
    pairs.write.options(**writers.CSV_WRITE).csv(f"{base}/pair_csv")
    writers.write_table(pairs, f"{base}/pair_jsonl", "jsonl")
    writers.write_chat_jsonl(chat_table(_messages(spark, folder)), f"{base}/chat_jsonl")
    out = None
    for name in ("pair_csv", "pair_jsonl", "chat_jsonl"):
        train, _ = detect.read_train_and_eval(spark, f"{base}/{name}")
        counted = readers.problem_counts(train).select(
            F.lit(name).alias("folder"),
            F.lit(detect.detect_format(spark, f"{base}/{name}")).alias("format"),
            "problem",
            "n",
        )
        out = counted if out is None else out.unionByName(counted)
    return out


def _cut_ids(samples: DataFrame) -> DataFrame:
    """``chat_id, turn, ids`` of the samples, cut at the sequence length chosen for all of them."""
    text = training_text(F.col("prompt"), F.col("completion"))
    table = stored(
        samples.select("chat_id", "turn", word_ids(text).alias("ids"), sample_tokens(F.col("prompt"), F.col("completion")).alias("n")),
        "samples",
    )
    length = table.agg(length_bucket(F.max("n"))).scalar()
    return table.select("chat_id", "turn", with_special(F.col("ids"), limit=length).alias("ids"))


def token_ids(spark, folder):
    ids = _cut_ids(training_samples(_messages(spark, folder), SECTIONED, 512))
    return ids.select(
        "chat_id", "turn", F.size("ids").cast("long").alias("n_ids"), F.array_join("ids", " ").alias("ids")
    )


def label_mask_query(spark, folder):
    ids = _cut_ids(training_samples(_messages(spark, folder), SECTIONED, 512))
    marker = CONTROL_TOKENS.index(SECTIONED.last_prompt_token)
    rows = ids.withColumn("labels", label_mask(F.col("ids"), marker))
    return rows.select("chat_id", "turn", F.array_join("labels", " ").alias("labels"))


def packed_blocks(spark, folder):
    samples = training_samples(_messages(spark, folder), SECTIONED, 512)
    ids = with_special(word_ids(training_text(F.col("prompt"), F.col("completion"))))
    table = samples.select("chat_id", "turn", ids.alias("ids")).withColumn("n_ids", F.size("ids"))
    blocks = pack(stored(table, "token-ids"), 256, shards=8)
    return blocks.select(
        "shard", "block", F.size("ids").cast("long").alias("n_ids"), F.array_join("ids", " ").alias("ids")
    )


def compact_samples_query(spark, folder):
    """The samples as intervals of turns, in both modes."""
    both = None
    for mode in (EXACT, REFERENCE):
        rows = compact_samples(_messages(spark, folder), MARKED, 250, mode).withColumn("mode", F.lit(mode))
        both = rows if both is None else both.unionByName(rows)
    return both.select("mode", "chat_id", "turn", "first_turn", "n_tokens")


def compact_rendered(spark, folder):
    messages = _messages(spark, folder)
    return rendered(messages, stored(compact_samples(messages, SECTIONED, 512), "compact"), SECTIONED)


def incremental_dedupe(spark, folder):
    """A batch of some of the chats, then one of the others and of copies of all."""
    facts = stored(chat_facts(_twice(_messages(spark, folder))), "facts")
    first = (F.col("chat_id") < COPY) & (F.pmod(F.xxhash64("chat_id"), F.lit(2)) == 0)
    seen, kept = SeenChats(spark, scratch_path(spark, "seen"), expected=1 << 16, buckets=8), None
    for batch in (facts.filter(first), facts.filter(~first)):
        new = stored(seen.unseen(batch), "unseen")
        seen.add(new)
        kept = new if kept is None else kept.unionByName(new)
    seen.close()
    return kept.select("chat_id", "n_messages")


def _dictionary_samples(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Stored tokens of the samples, and their stored dictionary."""
    samples = training_samples(_messages(spark, folder), SECTIONED, 512)
    tokens = stored(dictionary.tokenized(samples, training_text(F.col("prompt"), F.col("completion"))), "tokens")
    return tokens, stored(dictionary.vocabulary(tokens), "words")


def vocabulary(spark, folder):
    return _dictionary_samples(spark, folder)[1]


def _dictionary_cut(spark, folder) -> DataFrame:
    tokens, words = _dictionary_samples(spark, folder)
    length = tokens.agg(length_bucket(F.max(F.size("tokens")) + 2)).scalar()
    ids = dictionary.dictionary_ids(tokens, words)
    return ids.select("chat_id", "turn", with_special(F.col("ids"), limit=length).alias("ids"))


def dictionary_ids_query(spark, folder):
    return _dictionary_cut(spark, folder).select(
        "chat_id", "turn", F.size("ids").cast("long").alias("n_ids"), F.array_join("ids", " ").alias("ids")
    )


def dictionary_labels(spark, folder):
    marker = CONTROL_TOKENS.index(SECTIONED.last_prompt_token)
    rows = _dictionary_cut(spark, folder).withColumn("labels", label_mask(F.col("ids"), marker))
    return rows.select("chat_id", "turn", F.array_join("labels", " ").alias("labels"))


def dictionary_blocks(spark, folder):
    tokens, words = _dictionary_samples(spark, folder)
    ids = dictionary.dictionary_ids(tokens, words).withColumn("ids", with_special(F.col("ids")))
    blocks = pack(stored(ids.withColumn("n_ids", F.size("ids")), "token-ids"), 256, shards=8)
    return blocks.select(
        "shard", "block", F.size("ids").cast("long").alias("n_ids"), F.array_join("ids", " ").alias("ids")
    )


QUERIES: dict[str, Query] = {
    "normalize_roles": normalize_roles,
    "pc_to_chat": pc_to_chat,
    "chat_validity": chat_validity,
    "inference_validity": inference_validity,
    "chat_dedupe": chat_dedupe,
    "chat_row_dedupe": chat_row_dedupe,
    "row_dedupe": row_dedupe,
    "funnel_report": funnel_report,
    "funnel_full": funnel_full,
    "split_exact": split_exact_query,
    "split_report": split_report,
    "split_ordered": split_ordered_query,
    "turns": turns,
    "turn_cost": turn_cost,
    "preamble_cost": preamble_cost,
    "raw_string_tokens": raw_string_tokens,
    "overlong_drop": overlong_drop,
    "budget_fit_exact": budget_fit_exact,
    "budget_fit_reference": budget_fit_reference,
    "render_plain": _render(PLAIN),
    "render_sectioned": _render(SECTIONED),
    "render_marked": _render(MARKED),
    "render_custom_profile": _render(CUSTOM),
    "training_samples": training_samples_query,
    "training_set": training_set_query,
    "separate_eval": separate_eval,
    "prepare_folders": prepare_folders,
    "prepare_folders_split": prepare_folders_split,
    "gapped_positions": gapped_positions,
    "packed_file_samples": packed_file_samples,
    "training_text": training_text_query,
    "length_bucket": length_bucket_query,
    "sample_buckets": sample_buckets,
    "sample_preview": sample_preview,
    "chat_template_text": chat_template_text,
    "inference_prompts": inference_prompts,
    "reply_extract": reply_extract,
    "batch_generate": batch_generate_query,
    "csv_round_trip": csv_round_trip,
    "jsonl_round_trip": jsonl_round_trip,
    "pc_jsonl_round_trip": pc_jsonl_round_trip,
    "pair_csv_round_trip": pair_csv_round_trip,
    "csv_split_ranges": csv_split_ranges,
    "split_parquet_round_trip": split_parquet_round_trip,
    "table_formats": table_formats,
    "utf8_drop": utf8_drop,
    "utf8_drop_report": utf8_drop_report,
    "training_rows": training_rows_query,
    "format_detect": format_detect,
    "token_ids": token_ids,
    "label_mask": label_mask_query,
    "packed_blocks": packed_blocks,
    "compact_samples": compact_samples_query,
    "compact_rendered": compact_rendered,
    "incremental_dedupe": incremental_dedupe,
    "vocabulary": vocabulary,
    "dictionary_ids": dictionary_ids_query,
    "dictionary_labels": dictionary_labels,
    "dictionary_blocks": dictionary_blocks,
}
