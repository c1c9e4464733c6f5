"""The queries op1 to op13, each over its whole table, and SQL for what SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .attention_lm import score_documents
from .common import read
from .conversation_repair import repair_damaged
from .decontamination import contamination
from .hard_negatives import hard_negatives
from .html_text import extract_text
from .imatch import fingerprints
from .mixing import mix_sources
from .piece_codec import decode_pieces, encode_pieces
from .quality_classifier import classify_quality
from .repetition import quality_rules
from .secret_scan import scan_secrets
from .simhash import near_duplicates
from .url_filter import filter_urls

Query = Callable[[SparkSession, str], DataFrame]


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score is over the tokens of base_score, to which all unknown words are one."""
    return score_documents(read(spark, sf_dir, "documents"), spelled=False)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each text, and the digest of what they decode to."""
    decoded = decode_pieces(encode_pieces(read(spark, sf_dir, "documents")))
    return decoded.select("doc_id", "n_pieces", "piece_ids", F.sha2("text", 256).alias("decoded_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).taken()


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(read(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(read(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


# The columns of these queries that SQL can express, each from its operator.


def base1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def base5_text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = F.when(F.col("rule").isNotNull(), F.col("verdict"))
    return op6_url_filters(spark, sf_dir).select("page_id", "host", "path", "rule", ruled.alias("ruled"))


def base8_edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def base10_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_mixing(spark, sf_dir).select("doc_id", "size", "source_size", (F.col("taken") <= 3 * F.col("size")).alias("bounded"))


OPERATORS = (op1_lm_scoring, op2_html_extraction, op3_sentencepiece, op4_simhash, op5_quality_rules, op6_url_filters, op7_secret_scans, op8_fingerprints, op9_quality_classifier, op10_mixing, op11_decontamination, op12_hard_negatives, op13_conversation_repair, pipeline)
BASES = (base1_token_counts, base5_text_counts, base6_url_rules, base8_edited_texts, base10_sizes)
QUERIES: dict[str, Query] = {f.__name__: f for f in (*OPERATORS, *BASES)}

WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
ITEM_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Of ASCII text: a byte, then eight steps of a bit each.
CRC32_OF = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({}, ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END), 4294967295::BIGINT)"
CRC32 = CRC32_OF.format("CAST(doc_id AS VARCHAR)")



def repair_sql() -> str:
    """op13: states 0 to 3 (start, s, u, a last) over a conversation's rows, each the least (cost, audit, repaired lines)."""
    after = lambda x, cost, edit, line="": f"CASE WHEN {x} IS NULL THEN NULL ELSE {{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}', 'r': {x}.r{line}}} END"
    line = lambda role, text="b.body": f" || {role} || ':' || {text} || chr(10)"
    extra = "CASE WHEN b.fault = 't' THEN 5 ELSE 0 END"
    free = "b.fault NOT IN ('b', 'd')"

    def step(to: int, sources: tuple[str, ...], initial: str, role: str = "") -> str:
        ways = [after(f"s.s{to}", 2, "D")] + [f"CASE WHEN {free} AND b.initial = '{initial}' THEN {after(x, extra, 'K', line('b.role'))} END" for x in sources]
        ways += [f"CASE WHEN {free} THEN {after(x, '1 + ' + extra, 'R', line(repr(role)))} END" for x in sources if role]
        return f"least({', '.join(ways)})"

    moved = "{'initial': '', 'fault': '', 'role': '', 'body': '', 's0': " + step(0, (), "") + ", 's1': " + step(1, ("s.s0",), "s") + ", 's2': " + step(2, ("s.s0", "s.s1", "s.s3"), "u", "user") + ", 's3': " + step(3, ("s.s2",), "a", "assistant") + "}"
    user = lambda s: "least(" + ", ".join([f"{s}.s2", *(after(f"{s}.s{k}", 5, "I", line("'user'", "''")) for k in (0, 1, 3))]) + ")"
    u = lambda s: f"{{'initial': '', 'fault': '', 'role': '', 'body': '', 's0': {s}.s0, 's1': {s}.s1, 's2': {user(s)}, 's3': {s}.s3}}"
    a = lambda s: f"{{'initial': '', 'fault': '', 'role': '', 'body': '', 's0': {s}.s0, 's1': {s}.s1, 's2': {s}.s2, 's3': least({s}.s3, {after(f'{s}.s2', 5, 'I', line(repr('assistant'), repr('')))})}}"
    # each row in three steps, so that no expression stands in another twice: the edit, a user inserted, an assistant inserted
    reduced = f"list_reduce(list_concat([START], rows), lambda s, b: CASE b.role WHEN '+u' THEN {u('s')} WHEN '+a' THEN {a('s')} ELSE {moved} END)"
    state = "STRUCT(c BIGINT, a VARCHAR, r VARCHAR)"
    kind = f"STRUCT(initial VARCHAR, fault VARCHAR, role VARCHAR, body VARCHAR, s0 {state}, s1 {state}, s2 {state}, s3 {state})"
    start = f"CAST({{'initial': '', 'fault': '', 'role': '', 'body': '', 's0': {{'c': 0, 'a': '', 'r': ''}}, 's1': NULL, 's2': NULL, 's3': NULL}} AS {kind})"
    element = f"CAST({{'initial': %s, 'fault': %s, 'role': %s, 'body': %s, 's0': NULL, 's1': NULL, 's2': NULL, 's3': NULL}} AS {kind})"
    insertions = f"[{element % ("''", "''", "'+u'", "''")}, {element % ("''", "''", "'+a'", "''")}]"
    last = "regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1)"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32_OF.format("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k FROM conversations),
      x AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM c, range(0, 2) r(i) WHERE k <> 0 AND (i = 0 OR k = 3)),
      o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM x), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS nth FROM o),
      f AS (SELECT conv_id, n, turn, role, text, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN {last} NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM n),
      g AS (SELECT conv_id, list({element % ("left(role, 1)", "fault", "role", "text")} ORDER BY n) AS own, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
      count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
      p AS (SELECT *, list_concat({insertions}, flatten(list_transform(own, lambda y: list_concat([y], {insertions})))) AS rows FROM g), d AS (SELECT *, {reduced.replace("START", start)} AS e FROM p), b AS (SELECT *, least(e.s0, e.s3) AS z FROM d)
      SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(z.c, 0) AS cost, coalesce(z.a, '') AS audit, sha256(CASE WHEN z.r IS NULL OR z.r = '' THEN '' ELSE left(z.r, length(z.r) - 1) END) AS repaired_sha256
      FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN b ON o.conv_id IS NOT DISTINCT FROM b.conv_id"""


#: The operators' learned, pseudorandom or hashed columns have no SQL; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "base1_token_counts": f"""WITH d AS (SELECT doc_id, {CRC32} % 5 = 1 AS held_out, {WORDS.format(LOWER.format("text"))} AS w FROM documents), t AS (SELECT doc_id, held_out, unnest(w) AS word FROM d), c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
      n AS (SELECT (SELECT coalesce(sum(c), 0) FROM c) + count(*) FILTER (NOT held_out) AS n, (SELECT count(*) FROM c) + CASE WHEN count(*) FILTER (NOT held_out) > 0 THEN 1 ELSE 0 END AS v, count(*) FILTER (NOT held_out) AS docs FROM d),
      s AS (SELECT doc_id, count(c) AS known, sum(log10(coalesce(c, 0) + 0.5)) AS logs FROM t LEFT JOIN c USING (word) GROUP BY 1)
      SELECT d.doc_id, held_out, len(w) + 1 AS n_tokens, coalesce(known, 0) + CASE WHEN docs > 0 THEN 1 ELSE 0 END AS n_known, CAST(n AS BIGINT) AS train_tokens, round(coalesce(logs, 0) + log10(docs + 0.5) - (len(w) + 1) * log10(n + 0.5 * (v + 1)), 3) AS base_score FROM d CROSS JOIN n LEFT JOIN s ON s.doc_id = d.doc_id""",
    "base5_text_counts": f"""WITH d AS (SELECT doc_id, text, coalesce({WORDS.format("text")}, []) AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), g AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM d, range(1, 200000) r(i) WHERE i + 4 <= len(w)),
      k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g), p AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM k, range(0, 5) o(j) WHERE n > 1 GROUP BY 1), x AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      len(list_filter(l, lambda y: regexp_matches(y, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(l, lambda y: regexp_matches(y, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words FROM d LEFT JOIN p USING (doc_id))
      SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x""",
    "base6_url_rules": f"""WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages), h AS (SELECT page_id, CASE WHEN contains(url, '://') THEN {LOWER.format("regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*')")} ELSE '' END AS host, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
      r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) r(verdict, rh, rp)),
      m AS (SELECT page_id, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, rh || rp) AS k FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
      SELECT h.page_id, host, path, rule, verdict AS ruled FROM h LEFT JOIN m ON m.page_id = h.page_id AND k = 1""",
    "base8_edited_texts": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS a FROM documents) SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 3) || substr(a, 1, length(t) // 3)) AS edited_sha256 FROM d""",
    "base10_sizes": f"""SELECT doc_id, size, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) AS source_size, true AS bounded FROM (SELECT doc_id, source, CAST(coalesce(len({WORDS.format("text")}), 0) AS BIGINT) AS size FROM documents)""",
    "op11_decontamination": f"""WITH d AS (SELECT doc_id, coalesce({ITEM_WORDS.format(LOWER.format("text"))}, []) AS w FROM documents), q AS (SELECT item_id, {ITEM_WORDS.format(LOWER.format("text"))} AS w FROM benchmark),
      k AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, list_slice(w, i, i + 9) AS g FROM q, range(1, 100000) r(i) WHERE len(w) > 0 AND i <= greatest(1, len(w) - 9)), l AS (SELECT DISTINCT l FROM k),
      h AS (SELECT doc_id, i, l, item_id FROM (SELECT doc_id, i, l, list_slice(w, i, i + l - 1) AS g FROM d, l, range(1, 200000) r(i) WHERE i + l - 1 <= len(w)) JOIN k USING (l, g)),
      n AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, range(0, 10) o(j) WHERE j < l GROUP BY 1), t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
      SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op12_hard_negatives": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS node, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
      p AS (SELECT anchor_id, node AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, node) <= 5)
      SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, node) AS INT) AS rank, node AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
      WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10""",
    "op13_conversation_repair": repair_sql(),
}
