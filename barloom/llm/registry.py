"""The registered text queries and, where SQL can say it, their twins."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.base import stored, table
from barloom.llm.bpe import encoded
from barloom.llm.chat_format import chained, format_replies, learnt_text, parse_turns
from barloom.llm.decontamination import contamination, hit_places
from barloom.llm.exact_dedup import dedup_decisions
from barloom.llm.html_text import learn_weights, main_texts
from barloom.llm.lexical_search import ranked_search
from barloom.llm.mixing import mixing_draws
from barloom.llm.ngram_join import similar_documents
from barloom.llm.periodic_runs import collapsed, strongest
from barloom.llm.substring_dedup import remove_repeats
from barloom.llm.token_counts import token_counts
from barloom.llm.toxicity import held_out, scored, train
from barloom.llm.winnowing import as_text, compare_edited

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Conversation -1: control strings as texts.
PLANTED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED, said.schema)
    formatted = format_replies(
        chained(said.unionAll(planted), "conv_id", "turn", "role", "text"),
        tree="conv_id", node="node", parent="parent",
    )
    turns = formatted.withColumn("turns", parse_turns(F.col("formatted")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat_ws("\n", t.role, t.text, F.lit(""))), "")
    loss = learnt_text(F.col("formatted"), F.col("loss_spans"))
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeats(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_removed",
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


def op3_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing_draws(table(spark, sf, "documents"))


def op4_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return compare_edited(table(spark, sf, "documents")).select(
        "doc_id", "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("print").alias("fingerprint"),
        as_text("edited_print").alias("edited_fingerprint"),
        "near_edited", "near_next", "next_id",
    )


def op5_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    tokens = encoded(docs, VOCABULARY, keep_text=False)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return similar_documents(table(spark, sf, "documents"))


def op7_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup_decisions(table(spark, sf, "documents")).withColumnRenamed(
        "text_digest", "text_sha256"
    )


def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(table(spark, sf, "documents"), VOCABULARY)


def op9_html_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return main_texts(pages, learn_weights(pages))


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = stored(train(docs, table(spark, sf, "labels")), "toxicity-model")
    return scored(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents, their ends repeated from some word on."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    best = strongest(F.col("runs"))
    listed = F.transform(
        "runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    )
    lines = F.array_join(F.transform(listed, lambda line: F.concat(line, F.lit("\n"))), "")
    return collapsed(docs, edit=repeated_tail).withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op13_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    n_hit = F.size(hit_places(F.col("spans"))).cast("long")
    return contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")).select(
        F.col("id").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_fingerprints": op4_fingerprints,
    "op5_bpe": op5_bpe,
    "op6_ngram_join": op6_ngram_join,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_html_text": op9_html_text,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_ranked_search": op12_ranked_search,
    "op13_decontamination": op13_decontamination,
}

_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

_ESCAPED = r"""regexp_replace({}, '([<\[])(\\*)(/?(s>|(INST|SYS|ROLE|TURN)\]))', '\1\2\\\3', 'g')"""

_SMALL = (
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)
_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                          lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""

_WORD_12 = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD_13 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLES: dict[str, str] = {
    "op1_chat_format": f"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'),
                             (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        grouped AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)
                       AS turns,
                   coalesce(string_agg(text, '' ORDER BY turn, role, text)
                       FILTER (role = 'assistant'), '') AS loss,
                   sum(length({_ESCAPED.format("text")}) + CASE role WHEN 'system' THEN 11
                       WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
                       ELSE 20 + length({_ESCAPED.format("role")}) END)::BIGINT AS formatted_chars
            FROM said GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars,
               sha256(loss) AS loss_sha256, formatted_chars
        FROM grouped""",
    "op2_substring_dedup": r"""
        WITH said AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        spans AS (
            SELECT doc_id, place, array_to_string(words[place:place + 12], ' ') AS passage
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS place FROM said)),
        firsts AS MATERIALIZED (
            SELECT passage, min(doc_id) AS first FROM spans GROUP BY passage),
        gone AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(range(place, place + 13)) AS place
            FROM spans JOIN firsts USING (passage) WHERE first < doc_id),
        places AS (
            SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place
            FROM said),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n
            FROM places ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
        SELECT doc_id, len(words)::BIGINT AS n_words,
               (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
               sha256(coalesce(text, '')) AS kept_sha256
        FROM said LEFT JOIN kept USING (doc_id)""",
    "op6_ngram_join": r"""
        WITH RECURSIVE said AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        texts AS MATERIALIZED (
            SELECT array_to_string(words, ' ') AS passage, any_value(words) AS words,
                   min(doc_id) AS rep, count(*) AS size
            FROM said GROUP BY array_to_string(words, ' ')),
        grams AS MATERIALIZED (
            SELECT DISTINCT rep, array_to_string(words[place:place + 4], ' ') AS gram
            FROM (SELECT rep, words, unnest(range(1, greatest(len(words) - 3, 2))) AS place
                  FROM texts WHERE len(words) > 0)),
        counts AS MATERIALIZED (SELECT rep, count(*) AS n FROM grams GROUP BY rep),
        links AS MATERIALIZED (
            SELECT a, b FROM (
                SELECT x.rep AS a, y.rep AS b, count(*) AS common
                FROM grams AS x JOIN grams AS y USING (gram) WHERE x.rep != y.rep
                GROUP BY x.rep, y.rep)
            JOIN counts AS m ON m.rep = a JOIN counts AS n ON n.rep = b
            WHERE common >= 0.8 * (m.n + n.n - common)),
        reach AS (
            SELECT rep AS a, rep AS b FROM texts
            UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        classes AS (
            SELECT a AS rep, min(b) AS class_id, count(DISTINCT b) AS n_texts
            FROM reach GROUP BY a),
        linked AS (
            SELECT a AS rep, sum(size) AS n FROM links JOIN texts ON texts.rep = b GROUP BY a)
        SELECT doc_id, class_id, rep AS copy_of,
               (size - 1 + coalesce(n, 0))::BIGINT AS n_links, n_texts
        FROM said JOIN texts ON passage = array_to_string(said.words, ' ')
        JOIN classes USING (rep) LEFT JOIN linked USING (rep)""",
    "op7_exact_dedup": f"""
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept, sha256({_NORMAL}) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY {_NORMAL})""",
    "op11_periodic_runs": rf"""
        WITH said AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                   {_CRC32.format("doc_id::VARCHAR")} AS h FROM documents),
        cut AS (
            SELECT *, len(words) AS n, (h // 10) % greatest(len(words), 1) AS a FROM said),
        edited AS MATERIALIZED (
            SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(0, n), lambda i:
                       words[1 + CASE WHEN i < a THEN i ELSE
                             a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END])
                   ELSE words END AS words
            FROM cut),
        places AS MATERIALIZED (
            SELECT doc_id, n, unnest(words) AS word, unnest(range(0, n)) AS i FROM edited),
        same AS (
            SELECT x.doc_id, y.i - x.i AS q, x.i AS i
            FROM places AS x JOIN places AS y
                ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i
                AND (y.i - x.i) * 4 <= x.n),
        stretches AS (
            SELECT doc_id, q, min(i) AS start, count(*) + q AS length
            FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island
                  FROM same) GROUP BY doc_id, q, island),
        runs AS MATERIALIZED (
            SELECT doc_id, start, length, min(q) AS period FROM stretches
            WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
        listed AS (
            SELECT doc_id, count(*) AS n_runs,
                   string_agg(start || ',' || length || ',' || period || chr(10), ''
                              ORDER BY start, period) AS lines,
                   first({{'start': start, 'length': length, 'period': period}}
                         ORDER BY length::DOUBLE / period DESC, start, period) AS best
            FROM runs GROUP BY doc_id),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text
            FROM places ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length,
               best.period AS period, (1000 * best.length) // best.period AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256,
               sha256(coalesce(kept.text, '')) AS collapsed_sha256
        FROM said LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_ranked_search": f"""
        WITH said AS (
            SELECT doc_id, regexp_extract_all({_SMALL}, '{_WORD_12}') AS words FROM documents),
        sizes AS (
            SELECT doc_id, len(words) AS n FROM said WHERE len(words) > 0),
        whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sizes),
        held AS MATERIALIZED (
            SELECT doc_id, word, count(*) AS tf
            FROM (SELECT doc_id, unnest(words) AS word FROM said) GROUP BY ALL),
        asked AS (
            SELECT item_id, unnest(regexp_extract_all({_SMALL}, '{_WORD_12}')) AS word
            FROM benchmark),
        weights AS (
            SELECT word, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
            FROM (SELECT word, count(*) AS df FROM held GROUP BY word), whole),
        parts AS (
            SELECT doc_id, word,
                   w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))
                       AS part
            FROM held JOIN sizes USING (doc_id) JOIN weights USING (word), whole),
        scores AS (
            SELECT item_id, doc_id, sum(part)::BIGINT AS score
            FROM asked JOIN parts USING (word) GROUP BY item_id, doc_id HAVING sum(part) > 0)
        SELECT item_id, doc_id, score,
               row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
        FROM scores QUALIFY rank <= 20""",
    "op13_decontamination": f"""
        WITH said AS (
            SELECT doc_id, regexp_extract_all({_SMALL}, '{_WORD_13}') AS words FROM documents),
        items AS (
            SELECT item_id, words, least(len(words), 10) AS n
            FROM (SELECT item_id, regexp_extract_all({_SMALL}, '{_WORD_13}') AS words
                  FROM benchmark)
            WHERE len(words) > 0),
        grams AS MATERIALIZED (
            SELECT DISTINCT item_id::VARCHAR AS item, n, words[place:place + n - 1] AS gram
            FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS place FROM items)),
        spans AS MATERIALIZED (
            SELECT doc_id, place, n, words[place:place + n - 1] AS gram
            FROM (SELECT doc_id, n, words, unnest(range(1, len(words) - n + 2)) AS place
                  FROM said, (SELECT DISTINCT n FROM grams) WHERE len(words) >= n)),
        met AS MATERIALIZED (
            SELECT doc_id, place, spans.n, item FROM spans JOIN grams USING (gram)),
        hit AS (
            SELECT doc_id, count(DISTINCT spot) AS n_hit
            FROM (SELECT doc_id, unnest(range(place, place + n)) AS spot FROM met)
            GROUP BY doc_id),
        named AS (
            SELECT doc_id, count(DISTINCT item) AS n_items,
                   string_agg(DISTINCT item, ',' ORDER BY item) AS items
            FROM met GROUP BY doc_id)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM said LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
}
