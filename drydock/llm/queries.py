"""The registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drydock.llm import ann, decontamination, kd_sharding, language_id, licenses, line_dedup, lm_scoring, minhash, pieces
from drydock.llm import ranked_search, suffix_dedup, whitening, window_dedup
from drydock.llm.common import load

MIN_DOCS = 10
SHARDS = 8
BEST = 10
WINDOW = 35
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(load(spark, sf_dir, "documents"), width=2, percent=80)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.load_model(TOKENIZER)
    docs = pieces.tokenised(load(spark, sf_dir, "documents"), F.col("text"), model, "doc_id")
    return docs.select(
        "row.doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "round_trip",
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(load(spark, sf_dir, "documents"), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    dimensions = [kd_sharding.coordinate(F.col("source")), kd_sharding.coordinate(F.col("lang")), F.col("doc_id")]
    shards = kd_sharding.kd_shards(docs, dimensions, shards=SHARDS)
    return shards.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", F.round("similarity", 6).alias("similarity"), "first_word", "end_word")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(load(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (their source is the host) and web pages, with one model for both."""
    docs, pages = load(spark, sf_dir, "documents"), load(spark, sf_dir, "pages")
    table = language_id.fit(
        docs.select("text", F.col("lang").alias("label")), language_id.LANGUAGES, language_id.SAMPLE_ROWS
    )
    page = language_id.page_columns(F.col("html"), F.col("url"))
    rows = docs.select(
        "doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.col("lang").alias("declared"),
        F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"),
    ).unionByName(pages.select(
        F.lit(None).cast("long").alias("doc_id"), "page_id", *[c.alias(n) for n, c in page.items()]
    ))
    rows = rows.withColumn("id", F.struct("doc_id", "page_id"))
    found = language_id.identify(
        rows, table, "id", "text", F.col("declared"), F.col("host"), F.col("suffix")
    )
    return found.select("id.doc_id", "id.page_id", "lang", F.round("probability", 6).alias("probability"), "kept")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(load(spark, sf_dir, "documents"))
    return found.withColumn("notices", F.array_join("notices", ","))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    def values(rows: list[tuple[str, str]]) -> str:
        return ", ".join(f"({_sql_text(name)}, {_sql_text(text)})" for name, text in rows)

    published = licenses.published()
    short = [(name, text) for name, texts in licenses.NOTICES.items() for text in texts]
    short += sorted({(name, line) for name, _ in published for line in licenses.identifier_lines(name)})
    end = _sql_text(licenses.END)
    # The rule of OWNER_LINE, whose look-ahead is a second pattern here.
    start, wording = r"^[\s/*#;-]*", licenses.WORDING
    owner = [
        rf"{start}(copyright\b[\s:,]*(\(c\)|©|[0-9]{{4}}|[<{{\[])|©|\(c\)[\s:,]*(copyright|[0-9]{{4}})|all rights reserved)",
        rf"{start}copyright[\s:]+\p{{L}}",
    ]
    named, maybe, worded = map(_sql_text, [*owner, rf"{start}copyright[\s:]+{wording}"])

    def form(text: str) -> str:
        lines = (
            f"array_to_string(list_filter(string_split(lower({text}), chr(10)), "
            f"lambda line: NOT (regexp_matches(line, {named}) OR "
            f"(regexp_matches(line, {maybe}) AND NOT regexp_matches(line, {worded})))), ' ')"
        )
        for spelling, usual in licenses.EQUIVALENT:
            lines = f"replace({lines}, {_sql_text(spelling)}, {_sql_text(usual)})"
        return f"sha256(nullif(trim(regexp_replace({lines}, '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')), ''))"

    return f"""
    WITH published(license_id, body) AS (VALUES {values(published)}),
    forms AS (
        SELECT license_id, unnest(CASE WHEN contains(body, {end})
                                       THEN [body, split_part(body, {end}, 1) || {end}, split_part(body, {end}, 1)]
                                       ELSE [body] END) AS body
        FROM published),
    titled AS (SELECT license_id, trim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM forms),
    untitled AS (
        SELECT license_id, body[length(split_part(body, chr(10) || chr(10), 1)) + 3:] AS body
        FROM titled WHERE length(split_part(body, chr(10) || chr(10), 1)) <= 120),
    texts AS (
        SELECT * FROM forms UNION ALL SELECT * FROM untitled WHERE body <> ''
        UNION ALL SELECT * FROM (VALUES {values(short)})),
    known AS (
        SELECT digest, min(license_id) AS license_id
        FROM (SELECT license_id, {form("body")} AS digest FROM texts)
        WHERE digest IS NOT NULL GROUP BY digest),
    docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
    split AS (
        SELECT r, string_split_regex(text, '\\n[ \\t\\r]*\\n') AS paragraphs, string_split(text, chr(10)) AS lines
        FROM docs),
    parts AS (
        SELECT r, unnest(list_concat(CASE WHEN len(paragraphs) > 1 THEN paragraphs ELSE [] END,
                                     CASE WHEN len(lines) > 1 THEN lines ELSE [] END)) AS part
        FROM split),
    stated AS (
        SELECT r, list_sort(list_distinct(list(license_id))) AS notices, count(*) AS n_notices
        FROM (SELECT r, {form("part")} AS digest FROM parts) JOIN known USING (digest)
        GROUP BY r),
    whole AS (SELECT r, doc_id, {form("text")} AS digest FROM docs)
    SELECT doc_id, license_id, coalesce(array_to_string(notices, ','), '') AS notices, coalesce(n_notices, 0) AS n_notices
    FROM whole LEFT JOIN known USING (digest) LEFT JOIN stated USING (r)"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.kept_digests(load(spark, sf_dir, "documents"), min_docs=MIN_DOCS, keep_first=False)


LINE_DEDUP_SQL = f"""
    WITH docs AS (SELECT row_number() OVER () AS r, dense_rank() OVER (ORDER BY doc_id, text) AS d, doc_id,
                         string_split(coalesce(text, ''), chr(10)) AS lines
                  FROM documents),
    split AS (SELECT r, d, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
    keyed AS (
        SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM split),
    repeated AS (
        SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT d) >= {MIN_DOCS}),
    marked AS (SELECT keyed.*, repeated.key IS NOT NULL AS dropped FROM keyed LEFT JOIN repeated USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY r, doc_id"""


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(load(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), k=BEST)


def _terms_sql(table: str) -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format("coalesce(text, '')")
    pattern = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    return f"SELECT *, row_number() OVER () AS r, regexp_extract_all({lower}, '{pattern}') AS terms FROM {table}"


RANKED_SEARCH_SQL = f"""
    WITH docs AS ({_terms_sql("documents")}),
    items AS ({_terms_sql("benchmark")}),
    sizes AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n FROM docs WHERE len(terms) > 0),
    totals AS (SELECT CAST(count(*) AS BIGINT) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM sizes),
    tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term),
    weights AS (
        SELECT term, CAST(floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
        FROM tf, totals GROUP BY term, all_docs),
    asked AS (
        SELECT r AS item, item_id, term, count(*) AS times
        FROM (SELECT r, item_id, unnest(terms) AS term FROM items) GROUP BY r, item_id, term),
    scored AS (
        SELECT item, item_id, doc_id, r,
               CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * all_docs) // all_terms))))
                    AS BIGINT) AS score
        FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (r), totals
        GROUP BY item, item_id, doc_id, r),
    placed AS (
        SELECT item_id, doc_id, score,
               CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank
        FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= {BEST}"""


def op13_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = window_dedup.repeated_windows(load(spark, sf_dir, "documents"), width=WINDOW)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


WINDOW_DEDUP_SQL = f"""
    WITH docs AS (
        SELECT row_number() OVER () AS r, doc_id,
               regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
        FROM documents),
    placed AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS pos, len(words) AS n FROM docs),
    windows AS (
        SELECT r, pos, word, n,
               string_agg(word, ' ') OVER (PARTITION BY r ORDER BY pos
                                           ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS content
        FROM placed),
    counted AS (
        SELECT r, pos, word,
               pos + {WINDOW - 1} <= n
               AND count(*) FILTER (pos + {WINDOW - 1} <= n) OVER (PARTITION BY content) > 1 AS again
        FROM windows),
    marked AS (
        SELECT r, pos, word,
               bool_or(again) OVER (PARTITION BY r ORDER BY pos
                                    ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone
        FROM counted)
    SELECT doc_id, count(word) AS n_words, count(*) FILTER (gone) AS n_removed,
           sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM docs LEFT JOIN marked USING (r) GROUP BY r, doc_id"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_kd_sharding": op4_kd_sharding,
    "op5_decontamination": op5_decontamination,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_nearest": op7_nearest,
    "op8_language_id": op8_language_id,
    "op9_license_scan": op9_license_scan,
    "op10_line_dedup": op10_line_dedup,
    "op11_whitening": op11_whitening,
    "op12_ranked_search": op12_ranked_search,
    "op13_window_dedup": op13_window_dedup,
}

SQL: dict[str, str] = {
    "op9_license_scan": _license_sql(),
    "op10_line_dedup": LINE_DEDUP_SQL,
    "op12_ranked_search": RANKED_SEARCH_SQL,
    "op13_window_dedup": WINDOW_DEDUP_SQL,
}
