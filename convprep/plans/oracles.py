"""The registered queries as SQL over the same tables, for checking results.

The SQL is written for the flat tables, with windows and joins, so it shares no
approach with the array expressions it checks.
"""

from __future__ import annotations

from convprep.plans.queries import COPY, CUSTOM, DEFECTS
from convprep.profiles import CONTROL_TOKENS, MARKED, PLAIN, SECTIONED, Profile

WORD = r"[^ \t\n\r\f]+"


def _text(value: str) -> str:
    parts = ["'" + p.replace("'", "''") + "'" for p in value.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")"


def _words(column: str) -> str:
    return f"len(regexp_extract_all({column}, '{WORD}'))"


def _spaced(column: str) -> str:
    pattern = "|".join(t.replace("|", r"\|") for t in CONTROL_TOKENS)
    return f"regexp_replace({column}, '({pattern})', ' \\1 ', 'g')"


ROLE = """CASE lower(role) WHEN 'system' THEN 'System' WHEN 'user' THEN 'User'
    WHEN 'assistant' THEN 'Chatbot' WHEN 'chatbot' THEN 'Chatbot' ELSE role END"""

MESSAGES = f"SELECT conv_id AS chat_id, turn AS pos, {ROLE} AS role, text AS content FROM conversations"

TWICE = f"""SELECT * FROM ({MESSAGES})
    UNION ALL SELECT chat_id + {COPY}, pos, role, content FROM ({MESSAGES})"""

DEFECT_MESSAGES = f"""SELECT d || ':' || chat_id AS chat_id, pos,
    CASE WHEN d = 'users_as_system' AND role = 'User' THEN 'System'
         WHEN d = 'unknown_role' AND role = 'Chatbot' THEN 'Assistant'
         WHEN d = 'sides_swapped' AND role = 'User' THEN 'Chatbot'
         WHEN d = 'sides_swapped' AND role = 'Chatbot' THEN 'User'
         ELSE role END AS role,
    CASE WHEN d = 'no_content' AND pos = 0 THEN NULL ELSE content END AS content
    FROM ({MESSAGES}) CROSS JOIN (SELECT unnest({DEFECTS!r}) AS d)"""

PAIRS = """SELECT doc_id, split_part(text, chr(10), 1) AS prompt,
    substr(text, length(split_part(text, chr(10), 1)) + 2) AS completion FROM documents"""

PAIR_MESSAGES = f"""SELECT doc_id AS chat_id, 0::BIGINT AS pos, 'User' AS role, prompt AS content FROM ({PAIRS})
    UNION ALL SELECT doc_id, 1::BIGINT, 'Chatbot', completion FROM ({PAIRS})"""


def _with(*ctes: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ctes) + "\n"


def _valid(source: str, tag: str = "") -> list[tuple[str, str]]:
    """``v``: chat_id, n_messages, valid."""
    return [
        (
            f"n{tag}",
            f"""SELECT *, coalesce(sum(CASE WHEN role = 'Chatbot' THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id
            ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM {source}""",
        ),
        (
            f"g{tag}",
            f"""SELECT chat_id, t, count(*) AS n, count(*) FILTER (role = 'User') AS u,
            count(*) FILTER (role = 'System') AS s, max(CASE WHEN role = 'Chatbot' THEN pos END) AS e,
            bool_and(role IN ('System', 'User', 'Chatbot') AND content IS NOT NULL) AS known
            FROM n{tag} GROUP BY chat_id, t""",
        ),
        (
            f"v{tag}",
            f"""SELECT chat_id, sum(n)::BIGINT AS n_messages, bool_and(known)
            AND bool_and(e IS NULL OR u > 0 OR (s > 0 AND e > 1)) AND count(e) > 0 AS valid
            FROM g{tag} GROUP BY chat_id""",
        ),
    ]


def _unique(source: str, tag: str = "") -> list[tuple[str, str]]:
    """``f``: the first of each set of equal chats; the identity is the whole text."""
    return [
        (
            f"s{tag}",
            f"""SELECT chat_id, string_agg(role || chr(1) || content, chr(2) ORDER BY pos) AS body
            FROM {source} GROUP BY chat_id""",
        ),
        (
            f"f{tag}",
            f"""SELECT min(chat_id) AS chat_id, any_value(n_messages) AS n_messages
            FROM s{tag} JOIN v{tag} USING (chat_id) WHERE valid GROUP BY body""",
        ),
    ]


def _split(source: str, fraction: float) -> list[tuple[str, str]]:
    return [
        (
            "sp",
            f"""SELECT chat_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || chat_id), chat_id)
            <= trunc(count(*) OVER () * {fraction}::DOUBLE) THEN 'eval' ELSE 'train' END AS split FROM {source}""",
        )
    ]


def _piece(p: Profile, role: str = "role", content: str = "content") -> str:
    return f"""CASE WHEN {content} = '' THEN '' ELSE CASE {role} WHEN 'User' THEN {_text(p.user_open)}
        WHEN 'System' THEN {_text(p.system_open)} ELSE {_text(p.chatbot_open + p.reply_open)} END || {content}
        || CASE {role} WHEN 'Chatbot' THEN {_text(p.reply_close)} ELSE '' END || {_text(p.close)} END"""


def _preamble(p: Profile, column: str = "pre") -> str:
    block = f"{_text(p.system_open + p.preamble_title)} || {column} || {_text(p.close)}"
    return block if p.preamble_always else f"CASE WHEN {column} = '' THEN '' ELSE {block} END"


def _base(p: Profile, column: str = "pre") -> str:
    shown = f"{p.frame_tokens} + {_words(f'({_text(p.preamble_title)} || {column})')}"
    if not p.preamble_always:
        shown = f"CASE WHEN {column} = '' THEN 0 ELSE {shown} END"
    return f"({p.prefix_tokens} + {shown})"


def _cost(p: Profile) -> str:
    return f"""CASE WHEN content = '' THEN 0 ELSE {p.frame_tokens} + {_words('content')}
        + CASE role WHEN 'Chatbot' THEN {p.reply_frame_tokens} ELSE 0 END END"""


def _turns(p: Profile, tag: str = "") -> list[tuple[str, str]]:
    """``c``: preamble and base per chat; ``t``: turns that end in a reply."""
    return [
        (
            f"c{tag}",
            f"""SELECT *, {_base(p)} AS base FROM (SELECT chat_id,
            coalesce(max(CASE WHEN pos = 0 AND role = 'System' THEN content END), '') AS pre
            FROM n{tag} GROUP BY chat_id)""",
        ),
        (
            f"t{tag}",
            f"""SELECT chat_id, t, sum({_cost(p)}) AS cost,
            coalesce(string_agg(CASE WHEN role <> 'Chatbot' THEN {_piece(p)} END, '' ORDER BY pos), '') AS ask,
            max(CASE WHEN role = 'Chatbot' THEN {_piece(p)} END) AS reply,
            max(CASE WHEN role = 'Chatbot' THEN content END) AS completion,
            min(pos) AS first_pos, max(pos) AS end_pos, count(*) AS n_messages,
            count(*) FILTER (role = 'User') AS users, count(*) FILTER (role = 'System') AS systems
            FROM n{tag} WHERE NOT (pos = 0 AND role = 'System')
            GROUP BY chat_id, t HAVING count(*) FILTER (role = 'Chatbot') > 0""",
        ),
    ]


def _samples(p: Profile, budget: int, chosen: str, mode: str = "exact", tag: str = "") -> list[tuple[str, str]]:
    """``x``: samples of the chats in ``chosen``, from the CTEs of ``_valid`` and ``_turns``."""
    kept = (
        f"k{tag}",
        f"""SELECT t.*, base, pre, row_number() OVER w - 1 AS k, sum(cost) OVER w AS upto
        FROM t{tag} t JOIN c{tag} USING (chat_id) JOIN ({chosen}) USING (chat_id)
        WHERE cost > 0 AND base + cost <= {budget} WINDOW w AS (PARTITION BY chat_id ORDER BY t)""",
    )
    if mode == "exact":
        starts = (
            f"b{tag}",
            f"""SELECT a.chat_id, a.k, min(b.k) AS s FROM k{tag} a JOIN k{tag} b ON a.chat_id = b.chat_id AND b.k <= a.k
            AND a.base + a.upto - (b.upto - b.cost) <= {budget} GROUP BY a.chat_id, a.k""",
        )
    else:
        credit = 4 if p is MARKED else 1
        starts = (
            f"b{tag}",
            f"""SELECT chat_id, 0::BIGINT AS k, 0::BIGINT AS s FROM k{tag} WHERE k = 0
            UNION ALL SELECT a.chat_id, a.k, min(b.k) FROM b{tag} r
            JOIN k{tag} a ON a.chat_id = r.chat_id AND a.k = r.k + 1
            JOIN k{tag} b ON b.chat_id = r.chat_id AND b.k BETWEEN r.s AND a.k
            AND a.base + a.upto - (b.upto - b.cost) - {credit} * (b.k - r.s) <= {budget}
            GROUP BY a.chat_id, a.k""",
        )
    rows = (
        f"x{tag}",
        f"""SELECT a.chat_id, a.t::BIGINT AS turn, any_value(s.t)::BIGINT AS first_turn,
        any_value(a.base + a.upto - s.upto + s.cost)::BIGINT AS n_tokens,
        any_value({_preamble(p, 'a.pre')})
        || coalesce(string_agg(h.ask || h.reply, '' ORDER BY h.k) FILTER (h.k < a.k), '')
        || any_value(a.ask) || {_text(p.suffix)} AS prompt, any_value(a.completion) AS completion
        FROM k{tag} a JOIN b{tag} b ON a.chat_id = b.chat_id AND a.k = b.k
        JOIN k{tag} s ON s.chat_id = a.chat_id AND s.k = b.s
        JOIN k{tag} h ON h.chat_id = a.chat_id AND h.k BETWEEN b.s AND a.k
        GROUP BY a.chat_id, a.t""",
    )
    return [kept, starts, rows]


def _conversation_samples(p: Profile, budget: int, mode: str = "exact") -> str:
    ctes = [
        ("m", MESSAGES),
        *_valid("m"),
        *_turns(p),
        *_samples(p, budget, "SELECT chat_id FROM v WHERE valid", mode),
    ]
    text = _with(*ctes)
    return text if mode == "exact" else text.replace("WITH ", "WITH RECURSIVE ", 1)


def _set(source: str, budget: int, fraction: float = 0.2) -> str:
    return _with(
        ("m", source),
        *_valid("m"),
        *_unique("m"),
        *_split("f", fraction),
        *_turns(SECTIONED),
        *_samples(SECTIONED, budget, "SELECT chat_id FROM f"),
    )


def _whole_chat(p: Profile, cue: bool = True) -> str:
    """``r``: each chat rendered as a whole."""
    return _with(
        ("m", MESSAGES),
        (
            "r",
            f"""SELECT chat_id, {_text(p.prefix)} || {_preamble(p)} || body || {_text(p.suffix if cue else "")} AS rendered FROM (
            SELECT chat_id, coalesce(max(CASE WHEN pos = 0 AND role = 'System' THEN content END), '') AS pre,
            coalesce(string_agg(CASE WHEN pos > 0 OR role <> 'System' THEN {_piece(p)} END, '' ORDER BY pos), '') AS body
            FROM m GROUP BY chat_id)""",
        ),
    )


def _render(p: Profile) -> str:
    prompt = "rendered" if not p.prefix else f"substr(rendered, {len(p.prefix) + 1})"
    return _whole_chat(p) + f"SELECT chat_id, rendered, {prompt} AS prompt FROM r"


def _requests(p: Profile) -> str:
    """``q``: requests with the prompt, where it can be made."""
    return _with(
        ("m", MESSAGES),
        ("a", "SELECT chat_id, max(CASE WHEN role = 'User' THEN pos END) AS asked FROM m GROUP BY chat_id"),
        ("h", "SELECT m.* FROM m JOIN a ON m.chat_id = a.chat_id WHERE pos <= asked OR (pos = 0 AND role = 'System')"),
        ("hr", "SELECT * FROM h UNION ALL SELECT chat_id, asked + 1, 'Chatbot', '' FROM a WHERE asked IS NOT NULL"),
        *_valid("hr"),
        (
            "q",
            f"""SELECT chat_id AS req_id, message, CASE WHEN valid THEN
            {_text(p.prefix)} || {_preamble(p)} || body || {_text(p.suffix)} END AS prompt FROM (
            SELECT a.chat_id, coalesce(any_value(valid), false) AS valid,
            max(CASE WHEN pos = asked THEN content END) AS message,
            coalesce(max(CASE WHEN pos = 0 AND role = 'System' THEN content END), '') AS pre,
            coalesce(string_agg(CASE WHEN pos > 0 OR role <> 'System' THEN {_piece(p)} END, '' ORDER BY pos), '') AS body
            FROM a LEFT JOIN h ON h.chat_id = a.chat_id LEFT JOIN v ON v.chat_id = a.chat_id GROUP BY a.chat_id)""",
        ),
    )


def _ids(column: str) -> str:
    controls = "[" + ", ".join(f"'{t}'" for t in CONTROL_TOKENS) + "]"
    one = f"""CASE WHEN list_position({controls}, w) > 0 THEN list_position({controls}, w) - 1
        ELSE ('0x' || substr(md5(w), 1, 8))::BIGINT % 50000 + {len(CONTROL_TOKENS)} END"""
    listed = f"list_transform(regexp_extract_all({_spaced(column)}, '{WORD}'), lambda w: {one})"
    return f"list_concat(list_concat([0], {listed}), [2])"


_SEAM = "rtrim(prompt, ' ') || ltrim(completion, ' ')"


def _token_ids(select: str, samples: str | None = None) -> str:
    return (
        (samples or _conversation_samples(SECTIONED, 512))
        + f", i AS (SELECT chat_id, turn, {_ids(_SEAM)} AS full_ids FROM x)"
        + """, y AS (SELECT chat_id, turn, full_ids[1:(SELECT min(c) FROM (SELECT unnest([512, 1024, 2048, 4096, 8192,
        16384]) AS c) WHERE c > (SELECT max(len(full_ids)) FROM i))] AS ids FROM i)\n"""
        + select
    )


# Slot of a chat: the first 16 bits of a digest of its id.
_SLOT = "('0x' || substr(md5(chat_id::VARCHAR), 1, 4))::BIGINT"

_PACKED = f""", u AS (SELECT {_SLOT} AS slot, chat_id, turn, unnest(list_concat(full_ids, [2])) AS id,
    generate_subscripts(list_concat(full_ids, [2]), 1) AS i FROM i),
    o AS (SELECT *, slot % 8 AS shard,
    row_number() OVER (PARTITION BY slot % 8 ORDER BY slot, chat_id, turn, i) - 1 AS place FROM u)
    SELECT shard, place // 256 AS block, count(*) AS n_ids, string_agg(id::VARCHAR, ' ' ORDER BY place) AS ids
    FROM o GROUP BY shard, block"""



def _dictionary(select: str) -> str:
    """``dw``: words of the samples; ``dv``: their dictionary; ``i`` and ``y`` as in ``_token_ids``."""
    controls = "[" + ", ".join(f"'{t}'" for t in CONTROL_TOKENS) + "]"
    n = len(CONTROL_TOKENS)
    return (
        _conversation_samples(SECTIONED, 512)
        + f""", dl AS (SELECT chat_id, turn, regexp_extract_all({_spaced(_SEAM)}, '{WORD}') AS words FROM x),
        dw AS (SELECT chat_id, turn, unnest(words) AS token, generate_subscripts(words, 1) AS nth FROM dl),
        dc AS (SELECT token, count(*) AS n FROM dw GROUP BY token),
        dv AS (SELECT token, n, row_number() OVER (ORDER BY substr(md5(token), 1, 4), token) + {n} - 1 AS id
            FROM dc WHERE NOT list_contains({controls}, token)
            UNION ALL SELECT token, n, list_position({controls}, token) - 1 FROM dc WHERE list_contains({controls}, token)),
        i AS (SELECT chat_id, turn, list_concat(list_concat([0::BIGINT], list(id ORDER BY nth)), [2::BIGINT]) AS full_ids
            FROM dw JOIN dv USING (token) GROUP BY chat_id, turn),
        y AS (SELECT chat_id, turn, full_ids[1:(SELECT min(c) FROM (SELECT unnest([512, 1024, 2048, 4096, 8192,
        16384]) AS c) WHERE c > (SELECT max(len(full_ids)) FROM i))] AS ids FROM i)\n"""
        + select
    )


# Conversations under the digest of what they say, written as JSON.
_BY_DIGEST = f"""SELECT sha256(said) AS chat_id, pos, role, content FROM ({MESSAGES}) JOIN (
    SELECT chat_id, '{{"messages":[' || string_agg('{{"role":' || to_json(role) || ',"content":' || to_json(content)
    || '}}', ',' ORDER BY pos) || ']}}' AS said FROM ({MESSAGES}) GROUP BY chat_id) USING (chat_id)"""


# Fixed value of the end-of-prompt token's place among the control tokens.
_MARKER = CONTROL_TOKENS.index(SECTIONED.last_prompt_token)

_TWO_SIDES = _with(
    ("m", MESSAGES),
    *_valid("m"),
    *_unique("m"),
    *_turns(PLAIN),
    *_samples(PLAIN, 1024, "SELECT chat_id FROM f"),
    ("m2", PAIR_MESSAGES),
    *_valid("m2", "2"),
    *_unique("m2", "2"),
    *_turns(PLAIN, "2"),
    *_samples(PLAIN, 1024, "SELECT chat_id FROM f2", tag="2"),
)

_LABELS = f""", lb AS (SELECT *, list_position(list_reverse(ids), {_MARKER}) AS back FROM y)
    SELECT chat_id, turn, array_to_string(list_transform(range(1, len(ids) + 1),
    lambda i: CASE WHEN back > 0 AND i > len(ids) + 1 - back THEN ids[i] ELSE -100 END), ' ') AS labels FROM lb"""

ORACLES: dict[str, str] = {
    "normalize_roles": f"SELECT conv_id, turn, {ROLE} AS role, text FROM conversations",
    "pc_to_chat": PAIR_MESSAGES,
    "chat_validity": _with(("m", DEFECT_MESSAGES), *_valid("m")) + "SELECT chat_id, n_messages, valid FROM v",
    "inference_validity": _with(
        ("m0", MESSAGES),
        ("z", "SELECT chat_id, max(pos) AS last FROM m0 GROUP BY chat_id"),
        (
            "m",
            """SELECT chat_id * 2 + d AS chat_id, pos, role, content FROM m0 JOIN z USING (chat_id)
            CROSS JOIN (SELECT unnest([0, 1]) AS d) WHERE pos <= last - d
            UNION ALL SELECT chat_id * 2 + d, last - d + 1, 'Chatbot', '' FROM z CROSS JOIN (SELECT unnest([0, 1]) AS d)""",
        ),
        *_valid("m"),
    )
    + "SELECT chat_id // 2 AS chat_id, (chat_id % 2)::INTEGER AS dropped, valid FROM v",
    "chat_dedupe": _with(("m", TWICE), *_valid("m"), *_unique("m")) + "SELECT chat_id, n_messages FROM f",
    "chat_row_dedupe": _with(
        ("m", PAIR_MESSAGES),
        ("w", f"SELECT min(doc_id) AS chat_id FROM ({PAIRS}) GROUP BY prompt, completion"),
    )
    + "SELECT m.* FROM m JOIN w USING (chat_id)",
    "row_dedupe": f"SELECT DISTINCT prompt, completion FROM ({PAIRS})",
    "funnel_report": _with(
        ("m", f"SELECT chat_id::VARCHAR AS chat_id, pos, role, content FROM ({TWICE}) UNION ALL {DEFECT_MESSAGES}"),
        *_valid("m"),
        *_unique("m"),
    )
    + """SELECT 'loaded' AS stage, count(*) AS n FROM v
    UNION ALL SELECT 'valid', count(*) FROM v WHERE valid
    UNION ALL SELECT 'invalid', count(*) FROM v WHERE NOT valid
    UNION ALL SELECT 'unique', count(*) FROM f
    UNION ALL SELECT 'duplicate', (SELECT count(*) FROM v WHERE valid) - (SELECT count(*) FROM f)""",
    "funnel_full": _with(
        ("m", f"SELECT chat_id::VARCHAR AS chat_id, pos, role, content FROM ({TWICE}) UNION ALL {DEFECT_MESSAGES}"),
        *_valid("m"),
        *_unique("m"),
        ("u", "SELECT DISTINCT chat_id FROM m WHERE content IS NULL OR role IS NULL"),
        ("p", f"SELECT count(*) AS n, count(DISTINCT (prompt, completion)) AS k FROM ({PAIRS})"),
    )
    + """SELECT 'rows' AS kind, 'loaded' AS stage, 3 * n AS n FROM p
    UNION ALL SELECT 'rows', 'undecodable', n FROM p
    UNION ALL SELECT 'rows', 'invalid', 0
    UNION ALL SELECT 'rows', 'unique', k FROM p
    UNION ALL SELECT 'rows', 'duplicate', 2 * n - k FROM p
    UNION ALL SELECT 'chats', 'loaded', count(*) FROM v
    UNION ALL SELECT 'chats', 'undecodable', count(*) FROM u
    UNION ALL SELECT 'chats', 'invalid', count(*) FROM v WHERE NOT valid AND chat_id NOT IN (SELECT chat_id FROM u)
    UNION ALL SELECT 'chats', 'unique', count(*) FROM f
    UNION ALL SELECT 'chats', 'duplicate', (SELECT count(*) FROM v WHERE valid) - (SELECT count(*) FROM f)""",
    "split_exact": _with(("m", TWICE), *_valid("m"), *_unique("m"), *_split("f", 0.2))
    + "SELECT chat_id, split FROM sp",
    "split_report": _with(("m", MESSAGES), *_valid("m"), *_unique("m"), *_split("f", 0.29))
    + "SELECT split AS stage, count(*) AS n FROM sp GROUP BY split",
    "split_ordered": """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id)
        <= trunc(count(*) OVER () * 0.8::DOUBLE) THEN 'train' ELSE 'eval' END AS split FROM documents""",
    "turns": _with(("m", MESSAGES), *_valid("m"), *_turns(PLAIN))
    + "SELECT chat_id, t::BIGINT AS turn, first_pos, end_pos, n_messages, users, systems FROM t",
    "turn_cost": _with(("m", MESSAGES), *_valid("m"), *_turns(PLAIN), *_turns(MARKED, "2")).replace(
        "FROM n2", "FROM n"
    )
    + """SELECT chat_id, t::BIGINT AS turn, cost::BIGINT AS cost, 'plain' AS profile FROM t
    UNION ALL SELECT chat_id, t::BIGINT, cost::BIGINT, 'marked' FROM t2""",
    "preamble_cost": _with(
        (
            "c",
            f"""SELECT chat_id, coalesce(max(CASE WHEN pos = 0 AND role = 'System' THEN content END), '') AS pre,
            bool_or(pos = 0 AND role = 'System') AS has_preamble FROM ({MESSAGES}) GROUP BY chat_id""",
        )
    )
    + " UNION ALL ".join(
        f"SELECT chat_id, '{p.name}' AS profile, has_preamble, {_base(p)}::BIGINT AS base FROM c"
        for p in (PLAIN, SECTIONED, MARKED)
    ),
    "raw_string_tokens": _whole_chat(PLAIN)
    + ", "
    + _whole_chat(MARKED)[len("WITH ") :].replace("r AS (", "r2 AS (").split(",\n", 1)[1]
    + f"""SELECT chat_id, 'cue' AS kind, {_words(_spaced('rendered'))} - 2 AS n_tokens FROM r
    UNION ALL SELECT chat_id, 'marked_cue', {_words(_spaced('rendered'))} - 3 FROM r2
    UNION ALL SELECT chat_id, 'closed', {_words(_spaced('rendered'))} - 2 FROM r
    UNION ALL SELECT chat_id, 'raw', {_words(_spaced("rendered || 'ok'"))} + 1 FROM r""",
    "overlong_drop": _with(
        (
            "m",
            f"""SELECT 'as_is:' || chat_id AS chat_id, pos, role, content FROM ({MESSAGES})
            UNION ALL SELECT 'blank:' || chat_id, pos, role, '' FROM ({MESSAGES})""",
        ),
        *_valid("m"),
        *_turns(SECTIONED),
    )
    + """SELECT chat_id, t::BIGINT AS turn, cost::BIGINT AS cost, CASE WHEN cost = 0 THEN 'empty_turn'
    WHEN base + cost > 128 THEN 'over_budget' END AS reason FROM t JOIN c USING (chat_id)""",
    "budget_fit_exact": _conversation_samples(MARKED, 250)
    + "SELECT chat_id, turn, first_turn, n_tokens FROM x",
    "budget_fit_reference": _conversation_samples(MARKED, 250, "reference")
    + "SELECT chat_id, turn, first_turn, n_tokens FROM x",
    "render_plain": _render(PLAIN),
    "render_sectioned": _render(SECTIONED),
    "render_marked": _render(MARKED),
    "render_custom_profile": _render(CUSTOM),
    "training_samples": _conversation_samples(SECTIONED, 512) + "SELECT * FROM x",
    "training_set": _set(TWICE, 512) + "SELECT x.*, split FROM x JOIN sp USING (chat_id)",
    "separate_eval": _TWO_SIDES + "SELECT *, 'train' AS split FROM x UNION ALL SELECT *, 'eval' FROM x2",
    "prepare_folders": _TWO_SIDES
    + """SELECT * EXCLUDE (chat_id), 'train' AS split FROM x
    UNION ALL SELECT * EXCLUDE (chat_id), 'eval' FROM x2""",
    "prepare_folders_split": _set(_BY_DIGEST, 512)
    + "SELECT chat_id, turn, split, prompt, completion FROM x JOIN sp USING (chat_id)",
    "gapped_positions": _set(MESSAGES, 512) + "SELECT x.*, split FROM x JOIN sp USING (chat_id)",
    "packed_file_samples": _token_ids(_PACKED, _set(_BY_DIGEST, 512)),
    "training_text": _conversation_samples(SECTIONED, 512)
    + "SELECT chat_id, turn, rtrim(prompt || '  ', ' ') || ltrim('  ' || completion || ' ', ' ') AS text FROM x",
    "length_bucket": _set(MESSAGES, 16384)
    + f""", z AS (SELECT split, {_words(_spaced(_SEAM))} + 2 AS n FROM x JOIN sp USING (chat_id)),
    y AS (SELECT coalesce(max(n) FILTER (split = 'train'), 0) AS train_tokens,
    coalesce(max(n) FILTER (split = 'eval'), 0) AS eval_tokens FROM z)
    SELECT *, greatest(train_tokens, eval_tokens) AS max_tokens, (SELECT min(c)::BIGINT FROM
    (SELECT unnest([512, 1024, 2048, 4096, 8192, 16384]) AS c) WHERE c > greatest(train_tokens, eval_tokens))
    AS sequence_length FROM y""",
    "sample_buckets": _conversation_samples(MARKED, 16384)
    + f""", z AS (SELECT chat_id, turn, {_words(_spaced(_SEAM))} + 2 AS n_tokens FROM x)
    SELECT *, CASE WHEN n_tokens < 512 THEN 512 WHEN n_tokens < 1024 THEN 1024 WHEN n_tokens < 2048 THEN 2048
    WHEN n_tokens < 4096 THEN 4096 WHEN n_tokens < 8192 THEN 8192 WHEN n_tokens < 16384 THEN 16384
    END::BIGINT AS bucket FROM z""",
    "sample_preview": _conversation_samples(SECTIONED, 512) + "SELECT * FROM x ORDER BY chat_id, turn LIMIT 1",
    # Every message with its frame, and nothing after the last one.
    "chat_template_text": _whole_chat(PLAIN, cue=False) + "SELECT rendered AS text FROM r",
    "inference_prompts": _requests(MARKED)
    + "SELECT req_id, prompt, CASE WHEN prompt IS NULL THEN 'invalid_input' END AS problem FROM q",
    "reply_extract": _requests(PLAIN)
    + """SELECT req_id, 'whole' AS kind, 'An answer, ' || message AS text, NULL::VARCHAR AS problem
    FROM q WHERE prompt IS NOT NULL
    UNION ALL SELECT req_id, unnest(['cut', 'other']), NULL, 'truncated_generation' FROM q WHERE prompt IS NOT NULL""",
    "batch_generate": _requests(PLAIN)
    + """SELECT req_id, length(prompt) || ' characters' AS text, NULL::VARCHAR AS problem
    FROM q WHERE prompt IS NOT NULL""",
    "csv_round_trip": f"SELECT prompt, completion FROM ({PAIRS})",
    "jsonl_round_trip": f"SELECT pos, role, content FROM ({MESSAGES})",
    "pc_jsonl_round_trip": f"SELECT prompt, completion FROM ({PAIRS})",
    "pair_csv_round_trip": f"SELECT prompt, completion FROM ({PAIRS})",
    "csv_split_ranges": f"""SELECT prompt, completion || chr(10) || '"quoted",' || chr(13) || chr(10) || '"" end'
    AS completion FROM ({PAIRS})""",
    "split_parquet_round_trip": _set(MESSAGES, 512)
    + f"""SELECT prompt, completion, {_SEAM} AS text,
    CASE split WHEN 'eval' THEN 'test' ELSE split END AS split FROM x JOIN sp USING (chat_id)""",
    "table_formats": """SELECT part.*, f AS format FROM part
    CROSS JOIN (SELECT unnest(['csv', 'tsv', 'json', 'jsonl']) AS f)
    UNION ALL SELECT NULL, p_name, NULL, NULL, NULL, NULL, 'txt' FROM part""",
    "utf8_drop": f"SELECT prompt, completion FROM ({PAIRS}) UNION ALL SELECT prompt, completion FROM ({PAIRS})",
    "utf8_drop_report": """SELECT NULL::VARCHAR AS problem, 2 * count(*) AS n FROM documents
    UNION ALL SELECT 'not_utf8', count(*) FROM documents""",
    "training_rows": f"""WITH p AS (SELECT prompt, completion, min(doc_id) AS first FROM ({PAIRS}) GROUP BY ALL)
    SELECT prompt, completion, {_SEAM} AS text, CASE WHEN row_number() OVER (ORDER BY first)
    <= trunc(count(*) OVER () * 0.8::DOUBLE) THEN 'train' ELSE 'eval' END AS split FROM p""",
    "format_detect": """SELECT f AS folder, f AS format, NULL::VARCHAR AS problem, n FROM
    (SELECT unnest(['pair_csv', 'pair_jsonl']) AS f, count(*) AS n FROM documents)
    UNION ALL SELECT 'chat_jsonl', 'chat_jsonl', NULL, count(DISTINCT conv_id) FROM conversations""",
    "token_ids": _token_ids(
        "SELECT chat_id, turn, len(ids) AS n_ids, array_to_string(ids, ' ') AS ids FROM y"
    ),
    "label_mask": _token_ids(
        f""", l AS (SELECT *, list_position(list_reverse(ids), {_MARKER}) AS back FROM y)
    SELECT chat_id, turn, array_to_string(list_transform(range(1, len(ids) + 1),
    lambda i: CASE WHEN back > 0 AND i > len(ids) + 1 - back THEN ids[i] ELSE -100 END), ' ') AS labels FROM l"""
    ),
    "packed_blocks": _token_ids(_PACKED),
    "compact_samples": "SELECT 'exact' AS mode, * FROM ("
    + _conversation_samples(MARKED, 250)
    + "SELECT chat_id, turn, first_turn, n_tokens FROM x) UNION ALL SELECT 'reference', * FROM ("
    + _conversation_samples(MARKED, 250, "reference")
    + "SELECT chat_id, turn, first_turn, n_tokens FROM x)",
    "compact_rendered": _conversation_samples(SECTIONED, 512) + "SELECT * FROM x",
    "incremental_dedupe": _with(("m", TWICE), *_valid("m"), *_unique("m")) + "SELECT chat_id, n_messages FROM f",
    "vocabulary": _dictionary("SELECT token, n, id FROM dv"),
    "dictionary_ids": _dictionary(
        "SELECT chat_id, turn, len(ids) AS n_ids, array_to_string(ids, ' ') AS ids FROM y"
    ),
    "dictionary_labels": _dictionary(_LABELS),
    "dictionary_blocks": _dictionary(_PACKED),
}
