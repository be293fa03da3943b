"""DuckDB SQL for the results of the operators that SQL can express on whole tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
WORD = r"'[^\x20\x09-\x0D]+'"


def _seeded(seed: int) -> str:
    x = f"(((coalesce(doc_id, -1) % 2147483647) + 2147483647) % 2147483647 + {seed})"
    for factor in (48271, 69621):
        y = f"(({x} * {factor} + 12345) % 2147483647)"
        x = f"((xor({y} >> 15, {y}) * 16807) % 2147483647)"
    return x


def _apportion(name: str, given: str, within: str, key: str) -> str:
    """Highest quotients of votes / (2 k + 1): the rows of ``given`` with quota."""
    part = f"PARTITION BY {within}" if within else ""
    return f"""{name}1 AS (SELECT *, sum(votes) OVER ({part}) AS v_, count(*) OVER ({part}) AS n_ FROM {given}),
{name}2 AS (SELECT *, CASE WHEN v_ > 0 THEN least(greatest(0, CAST(floor(votes * (seats - n_ / 2) / v_ + 0.5) AS BIGINT)), cap) ELSE 0 END AS sure_ FROM {name}1),
{name}3 AS (SELECT *, seats - sum(sure_) OVER ({part}) AS left_, CASE WHEN v_ > 0 THEN least(CAST(ceil(votes * n_ / v_) AS BIGINT) + 2, cap - sure_) ELSE 0 END AS more_ FROM {name}2),
{name}4 AS (SELECT *, unnest(range(-1, CAST(more_ AS BIGINT))) AS k_ FROM {name}3),
{name}5 AS (SELECT *, CASE WHEN k_ >= 0 AND row_number() OVER ({part} ORDER BY CASE WHEN k_ >= 0 THEN votes / (2 * (sure_ + k_) + 1) END DESC NULLS LAST, {key} NULLS LAST) <= left_ THEN 1 ELSE 0 END AS won_ FROM {name}4),
{name} AS (SELECT {name}3.*, CAST(sure_ + w.won_ AS BIGINT) AS quota FROM {name}3 JOIN (SELECT {within + ',' if within else ''} {key}, sum(won_) AS won_ FROM {name}5 GROUP BY ALL) w ON {name}3.{key} IS NOT DISTINCT FROM w.{key} {f'AND {name}3.{within} IS NOT DISTINCT FROM w.{within}' if within else ''})"""


MIX = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORD})) AS size, {_seeded(18)} % 16384 AS bucket, {_seeded(17)} AS place FROM documents),
b AS (SELECT source, bucket, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source, bucket),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM b GROUP BY source),
s1 AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total, source_size * 3.0::DOUBLE AS most FROM s0),
s2 AS (SELECT *, most / weight AS level FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM s2 WINDOW w AS (ORDER BY level, source IS NULL, source)),
s4 AS (SELECT *, least(most, weight * (first_value(CASE WHEN level >= share THEN share END IGNORE NULLS) OVER (ORDER BY level, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))) AS target FROM s3),
s5 AS (SELECT source, source_size, target, target AS votes, CAST(floor(total / 16 + 0.5) AS BIGINT) AS seats, source_size * 3 // 16 AS cap FROM s4),
{_apportion('sq', 's5', '', 'source')},
n AS (SELECT source, source_size, target, quota, least(16384, greatest(1, CAST(ceil(source_size / 1048576) AS BIGINT))) AS n_shards FROM sq),
h0 AS (SELECT n.source, bucket % n_shards AS shard, CAST(sum(size) AS BIGINT) AS shard_size, first(quota) AS seats FROM b JOIN n ON b.source IS NOT DISTINCT FROM n.source GROUP BY ALL),
h1 AS (SELECT *, CAST(shard_size AS DOUBLE) AS votes, shard_size * 3 // 16 AS cap FROM h0),
{_apportion('hq', 'h1', 'source', 'shard')},
r AS (SELECT d.*, n.source_size, n.target, h.shard, h.shard_size, h.quota * 16 AS words FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source JOIN hq h ON d.source IS NOT DISTINCT FROM h.source AND d.bucket % n.n_shards = h.shard),
f AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before_ FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(CASE WHEN size > 0 THEN size * (words // greatest(shard_size, 1)) + greatest(0, least(words % greatest(shard_size, 1) - before_, size)) ELSE 0 END AS BIGINT) AS taken FROM f"""

_SHARE = {"symbols": "n_symbols / greatest(n_words, 1)", "letters": "n_letters / greatest(word_chars, 1)", "length": "word_chars / greatest(n_words, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)", "duplicates": "n_dup_lines / greatest(n_lines, 1)", "distinct_": "n_distinct_words / greatest(n_words, 1)", "upper_": "n_upper / greatest(n_letters, 1)", "marks": "n_marks / greatest(n_words, 1)"}
_MIDDLE = "n_words >= 15 AND n_words < 1000"
#: Where each rule votes bad and good.
RULES = {
    "r_symbols": ("symbols >= 0.1", "symbols <= 0.01"),
    "r_letters": ("n_words >= 20 AND letters < 0.88", "n_words >= 20 AND letters >= 0.94"),
    "r_word_length": ("n_words >= 20 AND (length < 3.5 OR length >= 6.5)", "n_words >= 20 AND length >= 4 AND length < 6"),
    "r_repetition": ("repeats >= 0.12 OR duplicates >= 0.25", "n_words >= 20 AND repeats <= 0.02 AND duplicates <= 0.05"),
    "r_variety": (f"{_MIDDLE} AND distinct_ < 0.6", f"{_MIDDLE} AND distinct_ >= 0.7"),
    "r_stutter": (f"{_MIDDLE} AND distinct_ < 0.45", f"{_MIDDLE} AND distinct_ >= 0.5"),
    "r_shouting": ("n_words >= 20 AND upper_ >= 0.2", "n_words >= 20 AND upper_ <= 0.05 AND n_upper > 0"),
    "r_exclamation": ("n_words >= 20 AND marks >= 0.2", "n_words >= 20 AND marks <= 0.05"),
}


def _quality(rounds: int = 30) -> str:
    """Statistics, counts of vote patterns, the rounds of expectation maximisation one after another, verdicts."""
    odds = "ln(good_ / (1 - good_))" + "".join(f" + CASE {r} WHEN 1 THEN ln(p_{r} / (1 - f_{r})) WHEN -1 THEN ln((1 - p_{r}) / f_{r}) ELSE 0 END" for r in RULES)
    steps = ["w0 AS MATERIALIZED (SELECT 0.8::DOUBLE AS good_, " + ", ".join(f"0.4::DOUBLE AS f_{r}, 0.97::DOUBLE AS p_{r}" for r in RULES) + ")"]
    for k in range(1, rounds + 1):
        each = f"SELECT p.*, n / (1 + exp(-greatest(-500.0, least(500.0, {odds})))) AS g FROM p, w{k - 1}"
        total = lambda cond, of: f"coalesce(sum(CASE WHEN {cond} THEN {of} END), 0)"
        found = lambda r: f"({total(f'{r} = -1', 'n - g')} + 0.4 * (0.1 * {total(f'{r} <> 0', 'n - g')} + 1)) / ({total(f'{r} <> 0', 'n - g')} + 0.1 * {total(f'{r} <> 0', 'n - g')} + 1)"
        passed = lambda r: f"({total(f'{r} = 1', 'g')} + 0.97 * (0.1 * {total(f'{r} <> 0', 'g')} + 1)) / ({total(f'{r} <> 0', 'g')} + 0.1 * {total(f'{r} <> 0', 'g')} + 1)"
        steps.append(f"w{k} AS MATERIALIZED (SELECT (coalesce(sum(g), 0) + 4.0) / (coalesce(sum(n), 0) + 5) AS good_, " + ", ".join(f"{found(r)} AS f_{r}, {passed(r)} AS p_{r}" for r in RULES) + f" FROM ({each}))")
    count = lambda pattern: f"len(regexp_extract_all(t, '{pattern}'))"
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS id FROM documents),
s AS (SELECT *, regexp_extract_all(t, {WORD}) AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORD})) AS l FROM d),
g AS (SELECT id, i, array_to_string(w[i : i + 4], ' ') AS x FROM (SELECT id, w, unnest(range(1, greatest(1, len(w) - 3))) AS i FROM s)),
c AS (SELECT id, x FROM g GROUP BY id, x HAVING count(*) > 1),
e AS (SELECT id, count(*) AS n FROM (SELECT DISTINCT id, unnest(range(i, i + 5)) AS at_ FROM g JOIN c USING (id, x)) GROUP BY id),
v AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, {count('[#*$%&|<>]')} AS n_symbols, len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(e.n, 0) AS BIGINT) AS n_repeat_words,
  len(list_distinct(w)) AS n_distinct_words, {count('[!?]')} AS n_marks, {count(chr(92) + 'p{Lu}')} AS n_upper, {count(chr(92) + 'p{L}')} AS n_letters FROM s LEFT JOIN e ON s.id = e.id),
u AS (SELECT *, {', '.join(f'{x} AS {name}' for name, x in _SHARE.items())} FROM v),
b AS (SELECT *, {', '.join(f'CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS {r}' for r, (bad, good) in RULES.items())} FROM u),
p AS MATERIALIZED (SELECT {', '.join(RULES)}, count(*) AS n FROM b GROUP BY ALL),
{', '.join(steps)}
SELECT doc_id, n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {odds} >= 0 AS kept FROM b, w{rounds}"""


LINES = rf"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
r AS (SELECT *, regexp_matches(line, {WORD}) AS has FROM l),
f AS (SELECT line, min((doc_id, no)) AS first, string_split(line, ' ') AS w FROM r WHERE has GROUP BY line),
o AS (SELECT line, first, 0 AS unit, w, len(w) AS n FROM f WHERE len(w) >= 7 UNION ALL SELECT line, first, 1, NULL, length(line) FROM f WHERE len(w) < 8 AND length(line) >= 7),
v AS (SELECT line, first, unit, n, pos, CASE unit WHEN 0 THEN array_to_string(list_concat(w[:pos - 1], w[pos + 1:]), ' ') ELSE substring(line, 1, pos - 1) || substring(line, pos + 1) END AS key FROM (SELECT *, unnest(range(1, n + 1)) AS pos FROM o WHERE n >= 8)),
near AS (SELECT b.line FROM v a JOIN v b ON a.unit = b.unit AND a.n = b.n AND a.pos = b.pos AND a.key = b.key WHERE a.first < b.first
  UNION SELECT b.line FROM o a JOIN v b ON a.unit = b.unit AND a.n = b.n - 1 AND b.key = a.line WHERE a.first < b.first
  UNION SELECT b.line FROM v a JOIN o b ON a.unit = b.unit AND b.n = a.n - 1 AND a.key = b.line WHERE a.first < b.first),
k AS (SELECT r.*, NOT has OR ((doc_id, no) = f.first AND r.line NOT IN (SELECT line FROM near)) AS stays FROM r LEFT JOIN f ON r.line = f.line)
SELECT d.doc_id, coalesce(CAST(sum(CAST(has AS BIGINT)) AS BIGINT), 0) AS n_lines, coalesce(CAST(sum(CAST(has AND NOT stays AS BIGINT)) AS BIGINT), 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(k.line, chr(10) ORDER BY no) FILTER (WHERE stays), '') END AS text
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id, d.text"""

def near(words: int) -> str:
    """Exact similarity by joining shingles; with fewer words, the whole sequence is one."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({FOLD}, {WORD}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(1, len(w) - {words - 1}) + 1), lambda i: array_to_string(w[i : i + {words - 1}], ' ')) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 80 * (x.n + y.n - both_)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
m AS (SELECT a, min(b) AS component_id FROM c GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.a = d.doc_id"""


REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS x FROM (SELECT *, unnest(range(0, greatest(0, n - 49))) AS s FROM d)),
f AS (SELECT x, min(doc_id) AS first FROM w GROUP BY x HAVING count(*) > 1),
hit AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 1 ELSE 0 END AS fresh FROM w JOIN f USING (x) WHERE first < doc_id),
run AS (SELECT doc_id, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS g, s FROM hit),
span AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM run GROUP BY doc_id, g),
kept AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_ FROM span),
tail AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last FROM span GROUP BY doc_id),
head AS (SELECT k.doc_id, string_agg(substr(h, CAST(2 * from_ + 1 AS BIGINT), CAST(2 * (a - from_) AS BIGINT)), '' ORDER BY a) AS h FROM kept k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN removed IS NULL THEN d.h ELSE head.h || substr(d.h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN tail ON tail.doc_id = d.doc_id LEFT JOIN head ON head.doc_id = d.doc_id"""

ITEM_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
LEAKS = f"""WITH d AS (SELECT doc_id, regexp_extract_all({FOLD}, {ITEM_WORD}) AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS id, regexp_extract_all({FOLD}, {ITEM_WORD}) AS w FROM benchmark),
p AS (SELECT DISTINCT id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS x FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0)),
z AS (SELECT DISTINCT n FROM p),
q AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS x FROM (SELECT d.*, z.n, unnest(range(1, greatest(1, len(w) - z.n + 2))) AS s FROM d, z)),
hit AS (SELECT DISTINCT doc_id, s, q.n, id FROM q JOIN p ON p.n = q.n AND p.x = q.x),
a AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM hit) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN o ON o.doc_id = d.doc_id"""

CHATS = """WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT l[1:n] AS x FROM (SELECT l, unnest(range(1, len(l))) AS n FROM c)),
m AS (SELECT l, min(conv_id) AS conv_id FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.x = c.l) GROUP BY l)
SELECT conv_id, part, CAST(len(l) AS BIGINT) AS n_turns, array_to_string(list_transform(l[part * 256 + 1 : part * 256 + 256], lambda x: '<|im_start|>' || replace(coalesce(x.r, ''), '<|', '< |') || chr(10) || replace(coalesce(x.t, ''), '<|', '< |') || '<|im_end|>' || chr(10)), '') AS text
FROM (SELECT *, unnest(range(0, (len(l) + 255) // 256)) AS part FROM m)"""

ORACLES = {
    "op1_mix_sources": MIX,
    "op2_quality_rules": _quality(),
    "op3_line_dedup": LINES,
    "op6_minhash_dedup": near(2),
    "op7_suffix_dedup": REPEATS,
    "op9_decontaminate": LEAKS,
    "op10_chat_format": CHATS,
}


def pipeline() -> str:
    """The stages of the corpus pipeline one inside the other; each names its input ``documents``."""
    columns = "doc_id, text, lang, source, n_chars"
    return f"""WITH kept1 AS (SELECT {columns} FROM documents JOIN (SELECT doc_id, kept FROM ({_quality()})) USING (doc_id) WHERE kept),
kept2 AS (WITH documents AS (SELECT * FROM kept1) SELECT doc_id, l.text, lang, source, length(l.text) AS n_chars FROM (SELECT doc_id, lang, source FROM documents) JOIN ({LINES}) l USING (doc_id) WHERE regexp_matches(l.text, {WORD})),
kept3 AS (WITH documents AS (SELECT * FROM kept2) SELECT {columns} FROM documents JOIN (SELECT doc_id, kept FROM ({near(5)})) USING (doc_id) WHERE kept),
kept4 AS (WITH documents AS (SELECT * FROM kept3) SELECT {columns} FROM documents JOIN (SELECT doc_id, contaminated FROM ({LEAKS})) USING (doc_id) WHERE NOT contaminated),
kept5 AS (WITH documents AS (SELECT * FROM kept4) SELECT {columns}, size, source_size, target, taken FROM documents JOIN ({MIX}) USING (doc_id) WHERE taken > 0)
SELECT * FROM kept5"""
