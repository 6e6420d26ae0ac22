"""Registered queries of the llm subpackage: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.rules import quote
from quarrymill.llm import byte_bpe, chat, fim, line_dedup, packing, pii, quality_cnn, quality_rules, repair, secret_scan, simhash, style_tree, topk
from quarrymill.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op3_byte_bpe(spark: SparkSession, directory: str) -> DataFrame:
    return byte_bpe.round_trip_digests(table(spark, directory, "documents"), *byte_bpe.public_vocabulary())


def op4_quality_rules(spark: SparkSession, directory: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, directory, "documents")).drop("n_lines")


def _op4_sql() -> str:
    q = quality_rules
    rules = {
        "short": f"n_words < {q.MIN_WORDS}",
        "repetitive": f"100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words",
        "symbols": f"100 * n_symbols > {q.MAX_SYMBOL_PERCENT} * n_words",
        "dup_lines": f"100 * n_dup_lines > {q.MAX_DUP_LINE_PERCENT} * n_lines",
        "word_length": f"(word_chars < {q.MIN_WORD_CHARS} * n_words OR word_chars > {q.MAX_WORD_CHARS} * n_words)",
    }
    each = lambda form: ", ".join(form.format(r=r, test=t) for r, t in rules.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT row, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word
  FROM (SELECT row, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
windows AS (SELECT row, pos, word || ' ' || lead(word) OVER w || ' ' || lead(word, 2) OVER w AS gram
  FROM words WINDOW w AS (PARTITION BY row ORDER BY pos)),
twice AS (SELECT row, unnest([pos, pos + 1, pos + 2]) AS pos
  FROM (SELECT row, pos, count(*) OVER (PARTITION BY row, gram) AS n FROM windows WHERE gram IS NOT NULL) WHERE n > 1),
repeated AS (SELECT row, count(DISTINCT pos) AS n FROM twice GROUP BY row),
sizes AS (SELECT row, count(*) AS n, sum(length(word))::BIGINT AS chars FROM words GROUP BY row),
lines AS (SELECT row, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
m AS (SELECT d.row, doc_id, source, coalesce(s.n, 0) AS n_words, coalesce(s.chars, 0) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines
  FROM d LEFT JOIN sizes s USING (row) LEFT JOIN lines l ON l.row = d.row LEFT JOIN repeated r ON r.row = d.row),
hosts AS (SELECT source, count(*) AS docs, {each("count(*) FILTER ({test}) AS {r}")} FROM m GROUP BY source),
totals AS (SELECT count(*) AS hosts, sum(docs) AS docs, {each("sum({r}) / sum(docs)::DOUBLE AS {r}")} FROM hosts),
spread AS (SELECT {each("sum(h.docs * (h.{r} / h.docs::DOUBLE - t.{r}) ** 2) / max(t.docs) AS {r}")} FROM hosts h, totals t),
between AS (SELECT {each("s.{r} - t.{r} * (1 - t.{r}) * (t.hosts - 1) / t.docs AS {r}")} FROM totals t, spread s),
weights AS (SELECT {each("CASE WHEN s.{r} > 0 THEN least(greatest(t.{r} * (1 - t.{r}) / s.{r} - 1, " + f"{q.PRIOR_LEAST}), {q.PRIOR_MOST}" + ") ELSE " + f"{q.PRIOR_MOST}" + " END AS {r}")}
  FROM totals t, between s),
flags AS (SELECT source, {each("h.{r} > 0 AND (h.{r} + t.{r} * w.{r}) / (h.docs + w.{r}) >= least(" + f"{q.HOST_LIMIT}, {q.HOST_FACTOR}" + " * t.{r}) AS {r}")} FROM hosts h, totals t, weights w),
judged AS (SELECT m.*, {rules["short"]} OR {rules["repetitive"]} AS base_failed, {" OR ".join(f"(f.{r} AND {t})" for r, t in rules.items())} AS by_host
  FROM m LEFT JOIN flags f ON m.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR by_host) AS kept FROM judged"""


def op5_simhash_near_dedup(spark: SparkSession, directory: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, directory, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op6_line_dedup(spark: SparkSession, directory: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, directory, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
    unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), marked AS (
  SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS dropped FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op1_best_fit_packing(spark: SparkSession, directory: str) -> DataFrame:
    return packing.pack_documents(table(spark, directory, "documents"), *packing.public_vocabulary())


def op2_secret_scan(spark: SparkSession, directory: str) -> DataFrame:
    scanned = secret_scan.scan_secrets(table(spark, directory, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("findings", lambda f: f["kind"] < len(secret_scan.BASE_RULES))
    kinds = F.col("findings.kind")
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{rule.kind}")
        for n, rule in enumerate(secret_scan.BASE_RULES)
    ]
    return scanned.select(
        "doc_id",
        *counts,
        F.sha2(secret_scan.span_list(base), 256).alias("base_sha256"),
        secret_scan.span_list(F.col("findings")).alias("spans"),
    )


def _op2_sql() -> str:
    assign, access = secret_scan.BASE_RULES[0].pattern, secret_scan.BASE_RULES[1].pattern
    pem, platform = (r.pattern for r in secret_scan.MORE_RULES)
    rules = ((0, assign, 2, 12), (1, access, 0, 18), (2, "[0-9a-f]+", 0, 16), (3, pem, 0, 27), (4, platform, 0, 40))
    each = " UNION ALL ".join(
        f"""SELECT row, {n} AS kind, generate_subscripts(m, 1) AS nth, unnest(list_transform(g[:len(m)], lambda x: length(x))) AS gap,
        unnest(list_transform(m, lambda x: length(x))) AS width, unnest(list_transform(t, lambda x: length(x))) >= {least} AS good
      FROM (SELECT row, string_split_regex(text, {quote(p)}) AS g, regexp_extract_all(text, {quote(p)}, 0) AS m,
        regexp_extract_all(text, {quote(p)}, {group}) AS t FROM docs)"""
        for n, p, group, least in rules
    )
    name = "['assign', 'access', 'hex', 'pem', 'platform'][kind + 1] || ':' || (stop - width) || ':' || stop"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
each AS ({each}),
placed AS (SELECT *, sum(gap + width) OVER (PARTITION BY row, kind ORDER BY nth)::BIGINT AS stop FROM each),
lists AS (
  SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg({name}, ',' ORDER BY stop - width, kind) FILTER (kind < 3) AS base,
    string_agg({name}, ',' ORDER BY stop - width, kind) AS spans
  FROM placed WHERE good GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN lists USING (row)"""


def op7_quality_cnn(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    return quality_cnn.score_documents(documents, quality_cnn.fit(documents, table(spark, directory, "labels")))


def op8_topk_threshold(spark: SparkSession, directory: str) -> DataFrame:
    vectors = table(spark, directory, "embeddings")
    queries = vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return topk.top_k(vectors, queries, 5)


OP8_SQL = """
WITH usable AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS ints FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.ints, v.ints)::BIGINT AS score
  FROM usable q JOIN usable v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.ints) = len(v.ints)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


#: Fixed by the contract: a conversation whose texts imitate the format.
FORGED = "\\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "conversations").select("conv_id", "turn", "role", "text")
    forged = spark.createDataFrame([(-7, 0, "user", FORGED), (-7, 1, "assistant", FORGED)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(forged)))


OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') AS said, regexp_replace(role, '(\\|###|</turn>|: )', '\\\1', 'g') AS who FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || who || ': ' || said || '</turn>') + 1)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id, alone
"""


def op10_pii_bilstm_crf(spark: SparkSession, directory: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, directory, "documents"), pii.trained_tagger())
    kinds = F.col("base.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{kind}") for n, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.span_list(F.col("base")), 256).alias("base_sha256"), pii.span_list(F.col("spans")).alias("spans"))


def op11_fill_in_middle(spark: SparkSession, directory: str) -> DataFrame:
    found = fim.fill_in_middle(table(spark, directory, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP11_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    sha256('{fim.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR h3 % 100 >= {fim.TRANSFORMED} OR contains(text, '{fim.PREFIX}') OR contains(text, '{fim.SUFFIX}') OR contains(text, '{fim.MIDDLE}') THEN 'plain'
      WHEN h4 % 100 < {fim.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:n], '') AS suf FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{fim.PREFIX}' || pre || '{fim.SUFFIX}' || suf || '{fim.MIDDLE}' || mid
    ELSE '{fim.SUFFIX}' || suf || '{fim.PREFIX}' || pre || '{fim.MIDDLE}' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


def op12_site_style_tree(spark: SparkSession, directory: str) -> DataFrame:
    return style_tree.extract_main_text(table(spark, directory, "pages"))


def op13_conversation_repair(spark: SparkSession, directory: str) -> DataFrame:
    found = repair.repair_conversations(repair.damaged(table(spark, directory, "conversations")))
    lines = F.transform("repaired", lambda turn: F.concat(turn["role"], F.lit(":"), turn["text"]))
    return found.withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256)).drop("repaired")


def _op13_sql() -> str:
    """All four states' best edits, row by row, each with its cost, audit and text."""
    r = repair
    far = f"{{'c': {1 << 40}::BIGINT, 'w': '', 't': ''}}"
    insert = lambda state, role: f"{{'c': {state}.c + {r.INSERT_COST}, 'w': {state}.w || '{r.INSERT}', 't': {state}.t || '{role}:' || chr(10)}}"
    turn = lambda state, cost, letter, role: f"{{'c': {state}.c + {cost} + extra, 'w': {state}.w || '{letter}', 't': {state}.t || {role} || ':' || text || chr(10)}}"
    gone = lambda state: f"{{'c': {state}.c + {r.DELETE_COST}, 'w': {state}.w || '{r.DELETE}', 't': {state}.t}}"
    least = lambda *options: f"list_min([{', '.join(options)}])"

    def taken(states: str, initial: str, role: str | None) -> list[str]:
        when = lambda test, option: f"CASE WHEN {test} THEN {option} ELSE {far} END"
        kept = [when(f"NOT doomed AND initial = '{initial}'", turn(x, r.KEEP_COST, r.KEEP, "role")) for x in states]
        return kept + ([when("NOT doomed", turn(x, r.REROLE_COST, r.REROLE, f"'{role}'")) for x in states] if role else [])

    with_users = f"SELECT *, {least('u', insert('z', 'user'), insert('s', 'user'), insert('a', 'user'))} AS u1"
    with_both = f"SELECT * REPLACE (u1 AS u, {least('a', insert('u1', 'assistant'))} AS a)"
    return f"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) x(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
named AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name, dense_rank() OVER (ORDER BY conv_id) AS conv FROM conversations),
parted AS (SELECT conv_id, conv, turn, role, text, xor(list_reduce(list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT),
    lambda p, x: xor(tab[(xor(p, x) & 255) + 1], p >> 8), 4294967295), 4294967295) % {r.PARTS} AS part FROM named, crc),
damaged AS (SELECT conv, turn, CASE part WHEN {r.TAKEN} THEN 'user' ELSE role END AS role,
    CASE part WHEN {r.EMPTIED} THEN '' WHEN {r.CUT} THEN regexp_replace(text, '[{r.ENDS}]', '', 'g') ELSE text END AS text,
    unnest(range(CASE part WHEN {r.REPEATED} THEN 2 ELSE 1 END)) AS copy FROM parted WHERE part <> {r.DROPPED}),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM damaged),
judged AS (SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS again,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut,
    lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY pos) AS before FROM placed),
rows AS MATERIALIZED (SELECT *, blank OR again AS doomed, CASE WHEN cut THEN {r.TRUNCATED_COST} ELSE 0 END AS extra FROM judged),
run(conv, pos, z, s, u, a) AS (
  SELECT DISTINCT conv, 0::BIGINT, {{'c': 0::BIGINT, 'w': '', 't': ''}}, {far}, {far}, {far} FROM named
  UNION ALL
  SELECT conv, pos, {gone('z')}, {least(gone('s'), *taken('z', 's', None))}, {least(gone('u'), *taken('zsa', 'u', 'user'))}, {least(gone('a'), *taken('u', 'a', 'assistant'))}
  FROM ({with_both} FROM ({with_users} FROM (SELECT p.conv, p.z, p.s, p.u, p.a, w.pos, w.role, w.text, w.initial, w.doomed, w.extra FROM run p JOIN rows w ON w.conv = p.conv AND w.pos = p.pos + 1)))
),
ends AS (SELECT conv, list_min([z, a]) AS won FROM ({with_both} FROM ({with_users} FROM run)) QUALIFY row_number() OVER (PARTITION BY conv ORDER BY pos DESC) = 1),
faults AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, won.c AS cost, won.w AS audit, sha256(left(won.t, length(won.t) - 1)) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM named) JOIN ends USING (conv) LEFT JOIN faults USING (conv)
"""


def queries() -> dict[str, Query]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_secret_scan": op2_secret_scan,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_quality_rules": op4_quality_rules,
        "op5_simhash_near_dedup": op5_simhash_near_dedup,
        "op6_line_dedup": op6_line_dedup,
        "op7_quality_cnn": op7_quality_cnn,
        "op8_topk_threshold": op8_topk_threshold,
        "op9_chat_format": op9_chat_format,
        "op10_pii_bilstm_crf": op10_pii_bilstm_crf,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_site_style_tree": op12_site_style_tree,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": _op2_sql(), "op4_quality_rules": _op4_sql(), "op6_line_dedup": OP6_SQL, "op8_topk_threshold": OP8_SQL, "op9_chat_format": OP9_SQL, "op11_fill_in_middle": OP11_SQL, "op13_conversation_repair": _op13_sql()}
