"""Queries of the corpus operators over the given tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import field, importable, new_folder
from .contentsort import content_sort_dedup
from .licences import scan_licences
from .nbest import encode_n_best
from .packing import pack_texts
from .paragraphs import duplicate_passages
from .prefixtrie import prefix_trie
from .pseudonym import pseudonymise
from .redirect import LOWER as _LOWER
from .redirect import UPPER as _UPPER
from .redirect import alias_edges, judge_urls
from .simhash import simhash_dedup
from .tokenfiles import read_tokens, token_checksums, write_tokens
from .topk import top_k
from .weaklabel import classify, fit
from .whitening import fit as fit_whitening
from .whitening import whiten

#: Secret of the pseudonyms; production jobs set their own.
PSEUDONYM_KEY = "corpus-pseudonyms"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (host, path, verdict) of op1.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the rules, block decisions spread over its aliases."""
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = judge_urls(pages.select("page_id", "url"), alias_edges(pages), rules)
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def op2_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1,024 tokens."""
    pieces = pack_texts(table(spark, sf_dir, "documents"), capacity=1024)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "cost")


def op3_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for their validated numbers and dates."""
    done = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return done.select("row.doc_id", "text", "found")


def op4_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak-label posterior, score and decision for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, fit(docs)).select("row.doc_id", "weak_posterior", "score", "kept")


def op5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate paragraphs (every line that is not empty) and passages of all documents."""
    return duplicate_passages(table(spark, sf_dir, "documents"), min_words=1).withColumnRenamed("id", "doc_id")


def op6_n_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every text, as checksums of their ids and of the text decoded from them."""
    found = encode_n_best(table(spark, sf_dir, "documents"), n=4)
    return found.select(F.col("id").alias("doc_id"), "rank", "score", "n_pieces", F.crc32("ids").alias("ids_crc32"), "text_crc32")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as token files in ascending doc_id order; counts and checksums from the files read back."""
    path = new_folder(spark, "tokens")
    docs = table(spark, sf_dir, "documents")
    write_tokens(docs, path)
    return token_checksums(read_tokens(spark, path, docs.schema["doc_id"].dataType)).withColumnRenamed("id", "doc_id")


def op8_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every 20th vector with all others."""
    return top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components: 3-word shingles, links at 3 or fewer differing bits."""
    found = simhash_dedup(table(spark, sf_dir, "documents"), width=3, max_bits=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates after white-space normalisation, dropped rows included."""
    found = content_sort_dedup(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the eight leading whitening components, a row a component."""
    vectors = table(spark, sf_dir, "embeddings")
    found = whiten(vectors, fit_whitening(vectors, components=8))
    entries = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "entry")
    return (found.select(field("row", "vec_id").alias("vec_id"), "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", entries)
            .select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "entry.whitened", "entry.explained", "identity_error"))


def op12_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and covered licence templates in every document."""
    found = scan_licences(table(spark, sf_dir, "documents"))
    starts, base = F.transform("places", lambda p: p["start"]), F.transform("places", lambda p: p["label"])
    covered = F.transform("spans", lambda s: s["label"])
    return found.select(
        "row.doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, covered))), ",").alias("labels"), "score")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt with shared heads, with the totals of every subtree."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = (op1_redirect_equivalence, op2_cost_packing, op3_feistel, op4_weak_labels, op5_paragraphs, op6_n_best, op7_token_files,
           op8_block_top_k, op9_simhash, op10_content_sort, op11_whitening, op12_licence_scan, op13_prefix_trie)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in QUERIES}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return {"op1_redirect_equivalence": f"""
        WITH RECURSIVE rules(rh, rp, rv) AS (VALUES {rules}),
        parsed AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN url[instr(url, '://') + 3:] ELSE '' END AS rest
                   FROM pages),
        own AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
                       regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\\?[^#]*)', 1) AS query
                FROM parsed),
        links AS (SELECT DISTINCT host || path || query AS a, regexp_replace(regexp_extract(regexp_extract(
                      html, '(?is)<link[^>]*rel="canonical"[^>]*>'), 'href="https?://([^"#]*)', 1), '&amp;', '&', 'g') AS b FROM own),
        edges AS (SELECT a, b FROM links WHERE b <> '' UNION SELECT b, a FROM links WHERE b <> ''),
        reach(a, b) AS (SELECT a, a FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
        named AS (SELECT DISTINCT host || path || query AS node, host, path FROM own UNION
                  SELECT b, regexp_extract(b, '^[^/?]*'), regexp_extract(b, '^[^/?]*([^?]*)', 1) FROM edges),
        best AS (SELECT node, rh || rp AS rule, rv, row_number() OVER (PARTITION BY node ORDER BY length(rh || rp) DESC) AS nth
                 FROM named JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
        bad AS (SELECT DISTINCT r.a FROM reach r JOIN best ON best.node = r.b AND nth = 1 AND rv = 'block')
        SELECT page_id, host, path, rule, CASE WHEN rv IS NOT NULL THEN rv WHEN bad.a IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
        FROM own LEFT JOIN best ON best.node = host || path || query AND nth = 1 LEFT JOIN bad ON bad.a = host || path || query""",
            "op8_block_top_k": """
        WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS z FROM embeddings
                   WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        met AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.z, c.z) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM met QUALIFY rank <= 20""",
            "op10_content_sort": """
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm)""",
            "op13_prefix_trie": """
        WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                             sha256(concat_ws(':', length(coalesce(role, '')), coalesce(role, ''), coalesce(text, ''))) AS digest
                      FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, digest, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
                       row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS place FROM said),
        heads AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_concat([4294967295], flatten(
                      [[(ord(c)::BIGINT >> k) & 1 FOR k IN range(8)] FOR c IN string_split(conv_id::VARCHAR, '')])),
                      lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 4 AS h FROM own),
        turns AS (SELECT h.conv_id, 0 AS part, place, digest, words FROM heads h JOIN own o ON o.conv_id = base AND place < h
                  UNION ALL SELECT o.conv_id, 1, place, digest, words FROM heads h JOIN own o ON o.conv_id = h.conv_id AND place >= h),
        lists AS (SELECT conv_id, list(digest ORDER BY part, place) AS said, list(words ORDER BY part, place) AS words
                  FROM turns GROUP BY conv_id),
        whole AS (SELECT conv_id, coalesce(said, []) AS said, coalesce(words, []) AS words FROM heads LEFT JOIN lists USING (conv_id)),
        paths AS (SELECT conv_id, depth, array_to_string(said[1:depth], ',') AS node, depth = len(said) AS ends,
                         CASE WHEN depth > 0 THEN array_to_string(said[1:depth - 1], ',') END AS parent, coalesce(words[depth], 0) AS words
                  FROM (SELECT *, unnest(range(len(said) + 1)) AS depth FROM whole)),
        nodes AS (SELECT node, depth, parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
                         string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends
                  FROM paths GROUP BY node, depth, parent),
        kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
        sums AS (SELECT p.node, p.depth, sum(n.saved) AS saved, count(*) FILTER (k.node IS NULL) AS leaves
                 FROM nodes n LEFT JOIN kids k ON k.node = n.node AND k.depth = n.depth
                 JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.node, p.depth)
        SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves,
               CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
        FROM nodes n JOIN sums s ON s.node = n.node AND s.depth = n.depth LEFT JOIN nodes a ON a.node = n.parent AND a.depth = n.depth - 1
        LEFT JOIN kids k ON k.node = n.node AND k.depth = n.depth"""}
