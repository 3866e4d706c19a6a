"""The operators' registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edgeloom.llm.sharding import shard_digest

    return shard_digest(table(spark, sf_dir, "documents"))


def op2_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edgeloom.llm.lm_scoring import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from edgeloom.llm.packing import pack_documents

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.drop("row_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edgeloom.llm.language_id import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


def op5_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edgeloom.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edgeloom.llm.url_filter import judge_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edgeloom.llm.line_dedup import remove_common_lines

    cut = remove_common_lines(table(spark, sf_dir, "documents"), count="removed_lines")
    return cut.select("doc_id", "removed_lines", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), "text")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from edgeloom.llm.sentencepiece_codec import encode_documents, read_model

    model = read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return encode_documents(table(spark, sf_dir, "documents"), model, outputs=False)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edgeloom.llm.minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edgeloom.llm.embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edgeloom.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_shared_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edgeloom.llm.lexical_search import rank_documents

    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_min_cut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edgeloom.llm.html_extraction import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_hmm_scoring": op2_hmm_scoring,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_language_id": op4_language_id,
    "op5_voronoi_topk": op5_voronoi_topk,
    "op6_url_filter": op6_url_filter,
    "op7_line_dedup": op7_line_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_shared_search": op12_shared_search,
    "op13_min_cut_html": op13_min_cut_html,
}

_FINITE = "list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"

#: What SQL can say: exact search, exact similarity of shingle sets and of vectors, and the components of their links.
#: The other operators train models, draw random orders or align texts; tests hold them against brute force.
SQL: dict[str, str] = {
    "op5_voronoi_topk": f"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q
            FROM embeddings WHERE len(embedding) > 0 AND {_FINITE}
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op9_minhash_dedup": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
        ), n AS (SELECT doc_id, len(s) AS n FROM s), x AS (SELECT doc_id, unnest(s) AS x FROM s
        ), p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
        ), l AS (
            SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
        ), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
        SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
            doc_id = least(doc_id, coalesce(m, doc_id)) AS kept FROM n LEFT JOIN m ON a = doc_id""",
    "op10_embedding_dedup": f"""
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE len(embedding) > 0 AND {_FINITE} AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
        ), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        m AS (SELECT a, min(b) AS m FROM r GROUP BY a), c AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
            vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
        FROM embeddings LEFT JOIN m ON m.a = vec_id LEFT JOIN c ON c.a = vec_id""",
    "op11_prefix_trie": """
        WITH o AS (
            SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
            FROM conversations WHERE conv_id IS NOT NULL
        ), c AS (
            SELECT conv_id, list({'r': r, 't': t} ORDER BY p) AS l, xor(4294967295::BIGINT, list_reduce(
                list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
                lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h
            FROM o GROUP BY conv_id
        ), s AS (
            SELECT c.conv_id, list_concat(coalesce(b.l[1:c.h], []), c.l[c.h + 1:]) AS l
            FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100
        ), m AS (
            SELECT conv_id, len(l) AS n, d, md5(to_json(l[1:d])::VARCHAR) AS k, CASE WHEN d > 0 THEN md5(to_json(l[1:d - 1])::VARCHAR) END AS pk,
                CASE WHEN d > 0 THEN length(l[d].t) ELSE 0 END AS chars
            FROM (SELECT *, unnest(range(len(l) + 1)) AS d FROM s)
        ), v AS (
            SELECT k, any_value(pk) AS pk, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
                bool_and(n = d) AS leaf, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
            FROM m GROUP BY k
        ), t AS (
            SELECT m.k, sum(leaf::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * v.chars)::BIGINT AS saved_tokens
            FROM v JOIN m ON m.conv_id = v.conv_id AND m.d <= v.depth GROUP BY m.k
        ), h AS (SELECT pk AS k, count(*) AS n_children FROM v WHERE pk IS NOT NULL GROUP BY pk)
        SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, v.ends_sha256
        FROM v JOIN t USING (k) LEFT JOIN h USING (k) LEFT JOIN v p ON p.k = v.pk""",
    "op12_shared_search": r"""
        WITH t AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
        ), d AS (SELECT *, len(t)::BIGINT AS n FROM t WHERE len(t) > 0
        ), c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d
        ), q AS (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
            FROM (SELECT DISTINCT item_id, text FROM benchmark)
        ), p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(t) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL
        ), w AS (
            SELECT t, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t
        ), s AS (
            SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // terms)))))::BIGINT AS score
            FROM q JOIN w USING (t) JOIN p USING (t) JOIN d USING (r), c GROUP BY ALL
        ), k AS (
            SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank
            FROM s JOIN d USING (r) WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20""",
    # What the given pages say in their markup: the headings and paragraphs of the article.
    "op13_min_cut_html": r"""
        WITH b AS (
            SELECT page_id, url, string_split_regex(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1), '</?(?:p|h1)>') AS b FROM pages
        ), t AS (
            SELECT page_id, url, array_to_string(list_filter(list_transform(b, lambda x: trim(regexp_replace(
                regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x,
                    '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'),
                    '&#(?:x27|39);', chr(39), 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b
        )
        SELECT page_id, url, text, length(text) AS n_chars FROM t""",
}
