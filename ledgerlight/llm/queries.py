"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import chat_texts
from .decontaminate import contamination
from .fingerprints import edited_fingerprints
from .licenses import license_scan
from .ngram_jaccard import jaccard_components
from .pieces import encode_documents
from .quality import quality_scores, train
from .scratch import Scratch
from .spelling import spelling_variants
from .substring_dedup import substring_dedup
from .token_file import token_files
from .top_k import top_k
from .trie import placed_turns, trie_nodes, with_borrowed_heads
from .urls import url_verdicts


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; the vocabulary is never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = train(documents, _table(spark, sf_dir, "labels"))
    return quality_scores(documents.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")


def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")).drop("ids")


def token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages").select("page_id", "url"))


def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), every=100, k=10)


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_texts(_table(spark, sf_dir, "conversations"))


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that begin with the turns of another one, as the contract builds them, then their trie."""
    scratch = Scratch(spark, "trie")
    turns = scratch.save(placed_turns(_table(spark, sf_dir, "conversations"), scratch), "turns")
    return trie_nodes(*with_borrowed_heads(turns, scratch), scratch)


def spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": ngram_jaccard,
        "op2_license_scan": licenses,
        "op3_substring_dedup": substrings,
        "op4_quality_classifier": quality,
        "op5_sentencepiece": sentencepiece,
        "op6_token_binary": token_binary,
        "op7_decontamination": decontamination,
        "op8_url_filter": urls,
        "op9_exact_topk": topk,
        "op10_chat_format": chat,
        "op11_conversation_trie": conversation_trie,
        "op12_spelling_variants": spelling,
        "op13_fingerprints": fingerprint,
    }


#: A window is 20 words; each repeat of an earlier window removes the words that it covers.
_SUBSTRINGS = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS key FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM again)),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

#: Every pair of documents that share a shingle is counted; links reach on by recursion.
_JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT r.a AS doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""

_TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

_CHAT = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
    '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS turn FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, place, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS text, place = count(*) OVER (PARTITION BY conv_id) AS last FROM t),
whole AS (SELECT min(conv_id) AS conv_id, place AS n_turns, count(*) AS n_logs, text FROM p WHERE last GROUP BY place, text)
SELECT conv_id, n_turns, n_logs, text FROM whole ANTI JOIN (SELECT DISTINCT place AS n_turns, text FROM p WHERE NOT last) i USING (n_turns, text)
"""

#: crc32 goes by a table of 256 values, which SQL makes by rule.
_CRC = r"""
crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(0, 256)) AS i)))"""


def _crc(text: str) -> str:
    """SQL for the crc32 of the UTF-8 bytes of an expression."""
    octets = f"list_transform(range(0, CAST(length(hex({text})) // 2 AS INTEGER)), lambda i: CAST('0x' || substr(hex({text}), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


_TRIE = f"""
WITH {_CRC.strip()},
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS n_chars FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc("CAST(conv_id AS VARCHAR)")} % 6 AS h, n FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id), crc),
k AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS head FROM c LEFT JOIN c b ON b.conv_id = c.base),
turns AS (SELECT k.conv_id, t.place, digest, n_chars FROM k JOIN t ON t.conv_id = k.base AND t.place <= k.head UNION ALL SELECT k.conv_id, t.place - h + head AS place, digest, n_chars FROM k JOIN t USING (conv_id) WHERE t.place > h),
p AS (SELECT conv_id, place AS depth, n_chars, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS path FROM turns UNION ALL SELECT conv_id, 0, 0, '' FROM k),
p2 AS (SELECT p.*, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
node AS (SELECT min(conv_id) AS conv_id, depth, path, count(*) AS n_convs, any_value(n_chars) AS n_chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p2 GROUP BY depth, path),
up AS (SELECT node.*, u.conv_id AS parent, u.path AS parent_path FROM node LEFT JOIN p ON p.conv_id = node.conv_id AND p.depth = node.depth - 1 LEFT JOIN node u ON u.depth = p.depth AND u.path = p.path),
kids AS (SELECT depth - 1 AS depth, parent_path AS path, count(*) AS n FROM up WHERE parent IS NOT NULL GROUP BY ALL),
val AS (SELECT up.*, coalesce(kids.n, 0) AS n_children FROM up LEFT JOIN kids USING (depth, path)),
below AS (SELECT a.depth, a.path, sum(CAST(v.n_children = 0 AS INTEGER)) AS n_leaves, sum((v.n_convs - 1) * v.n_chars) AS saved FROM val v JOIN p a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY a.depth, a.path)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256 FROM val JOIN below USING (depth, path)
"""

#: Words one edit apart by what is left without one letter: the same at the same place, or the other word as a whole.
_SPELLING = rf"""
WITH RECURSIVE {_CRC.strip()},
runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, k, {_crc("(doc_id || ':' || run)")} AS h FROM runs, crc),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.rest UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.rest),
best AS (SELECT word, other, m, n_near FROM (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS r FROM near) WHERE r = 1),
forms AS (SELECT v.word, CASE WHEN m >= 2 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
way AS (SELECT word, word AS at FROM forms UNION ALL SELECT way.word, form FROM way JOIN forms ON forms.word = way.at WHERE form IS NOT NULL)
SELECT f.word, f.form, way.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN way USING (word) JOIN forms last ON last.word = way.at AND last.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": _JACCARD, "op3_substring_dedup": _SUBSTRINGS, "op9_exact_topk": _TOP_K, "op10_chat_format": _CHAT, "op11_conversation_trie": _TRIE, "op12_spelling_variants": _SPELLING}
