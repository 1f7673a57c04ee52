"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.sources import table


def op1_suffix_automaton_dedup(spark: SparkSession, root: str) -> DataFrame:
    from quern.llm.substring import dedup_substrings

    return dedup_substrings(table(spark, root, "documents"))


#: Every window of 35 words and how often it occurs; a word goes if one of the windows over it occurs again.
OP1_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), starts AS (
  SELECT row_id, words, unnest(range(1, len(words) - 33)) AS pos FROM texts WHERE len(words) >= 35
), windows AS (
  SELECT row_id, pos, sha256(array_to_string(list_slice(words, pos, pos + 34), ' ')) AS h FROM starts
), again AS (
  SELECT row_id, list(pos) AS ats FROM (SELECT row_id, pos, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1 GROUP BY row_id
), gone AS (
  SELECT row_id, list_distinct(flatten(list_transform(ats, lambda a: range(a, a + 35)))) AS places FROM again
), placed AS (
  SELECT t.row_id, t.doc_id, t.words, coalesce(g.places, []) AS places FROM texts t LEFT JOIN gone g USING (row_id)
), kept AS (
  SELECT p.row_id, string_agg(w, ' ' ORDER BY i) AS text
  FROM (SELECT row_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM texts) p
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT row_id, unnest(places) AS i FROM gone) g WHERE g.row_id = p.row_id AND g.i = p.i)
  GROUP BY p.row_id
)
SELECT p.doc_id, CAST(len(p.words) AS BIGINT) AS n_words, CAST(len(p.places) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM placed p LEFT JOIN kept k USING (row_id)
"""


def op2_log_bilinear_scores(spark: SparkSession, root: str) -> DataFrame:
    from quern.llm.language import score_language

    return score_language(table(spark, root, "documents"))


def op3_html_main_text(spark: SparkSession, root: str) -> DataFrame:
    from quern.llm.extraction import extract_pages

    return extract_pages(table(spark, root, "pages"))


def op4_best_fit_packing(spark: SparkSession, root: str) -> DataFrame:
    from quern.llm.packing import pack

    return pack(table(spark, root, "documents"))


def op5_pivot_permutation_links(spark: SparkSession, root: str) -> DataFrame:
    from quern.llm.neighbours import link_vectors

    return link_vectors(table(spark, root, "embeddings"))


#: Every pair by brute force; links are followed to the end.
OP5_SQL = """
WITH RECURSIVE vectors AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), sound AS (
  SELECT * FROM vectors WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r AS a, b.r AS b FROM sound a JOIN sound b ON a.r <> b.r AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach(r, s) AS (
  SELECT r, r FROM vectors UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.s
), least AS (
  SELECT reach.r, min(o.vec_id) AS component_id FROM reach JOIN vectors o ON o.r = reach.s GROUP BY reach.r
), numbers AS (
  SELECT a AS r, count(*) AS n FROM links GROUP BY a
)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, l.component_id, coalesce(v.vec_id = l.component_id, false) AS kept
FROM vectors v JOIN least l USING (r) LEFT JOIN numbers n USING (r)
"""


def op6_nbsvm_quality(spark: SparkSession, root: str) -> DataFrame:
    from quern.llm.quality import score_quality

    return score_quality(table(spark, root, "documents"), table(spark, root, "labels"))


def op9_token_combination_join(spark: SparkSession, root: str) -> DataFrame:
    from quern.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, root, "documents"))


#: Distinct sets are joined on their shingles; links are followed to the end.
OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT row_id, doc_id,
         CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
              ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s
  FROM words
), classes AS (
  SELECT min(row_id) AS c, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), tokens AS (
  SELECT c, n, unnest(s) AS t FROM classes
), links AS (
  SELECT a.c AS a, b.c AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.c <> b.c AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 190 * count(*) >= 90 * (a.n + b.n)
), reach(c, r) AS (
  SELECT c, c FROM classes UNION SELECT reach.c, links.b FROM reach JOIN links ON links.a = reach.r
), roots AS (
  SELECT c, min(r) AS root FROM reach GROUP BY c
), members AS (
  SELECT s.row_id, s.doc_id, s.s, r.root FROM sets s LEFT JOIN classes k ON k.s = s.s LEFT JOIN roots r ON r.c = k.c
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles,
       CASE WHEN root IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY root) END AS component_id
FROM members
"""


def op7_jump_sharding(spark: SparkSession, root: str) -> DataFrame:
    from quern.llm.sharding import shard_documents

    return shard_documents(table(spark, root, "documents"))


def op8_pivotal_mixing(spark: SparkSession, root: str) -> DataFrame:
    from quern.llm.mixing import mix_documents

    return mix_documents(table(spark, root, "documents"))


def op10_small_world_search(spark: SparkSession, root: str) -> DataFrame:
    from quern.llm.hnsw import search_vectors

    vectors = table(spark, root, "embeddings")
    return search_vectors(vectors, vectors.where("vec_id % 20 = 0"))


def op11_deficit_round_robin_packing(spark: SparkSession, root: str) -> DataFrame:
    from quern.llm.proportions import pack_mixture

    return pack_mixture(table(spark, root, "documents"))


#: Steps in order, and the kind that ends an attempt.
FUNNELS = {
    "A": (("view", "click", "view", "purchase"), "error"),
    "B": (("signup", "view", "click", "purchase"), "error"),
    "C": (("click", "click", "purchase", "view"), "signup"),
}


def op12_backward_fill_funnels(spark: SparkSession, root: str) -> DataFrame:
    from quern.llm.funnels import count_funnels

    return count_funnels(table(spark, root, "clicks"), FUNNELS)


#: Each row's next row of every kind by a range frame; steps follow these, one join for each.
OP12_SQL = """
WITH steps_of AS (
  SELECT DISTINCT client_id, kind, ts FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL
), nexts AS (
  SELECT *,
    min(CASE WHEN kind = 'view' THEN ts END) OVER w AS view, min(CASE WHEN kind = 'click' THEN ts END) OVER w AS click,
    min(CASE WHEN kind = 'purchase' THEN ts END) OVER w AS purchase, min(CASE WHEN kind = 'error' THEN ts END) OVER w AS error, min(CASE WHEN kind = 'signup' THEN ts END) OVER w AS signup
  FROM steps_of WINDOW w AS (PARTITION BY client_id ORDER BY ts RANGE BETWEEN INTERVAL 1 MICROSECOND FOLLOWING AND UNBOUNDED FOLLOWING)
), funnels(funnel, k1, k2, k3, k4, out) AS (
  VALUES ('A', 'view', 'click', 'view', 'purchase', 'error'), ('B', 'signup', 'view', 'click', 'purchase', 'error'), ('C', 'click', 'click', 'purchase', 'view', 'signup')
), moves AS (
  SELECT client_id, kind, ts, f.funnel, f.out, k.step,
    CASE k.next WHEN 'view' THEN view WHEN 'click' THEN click WHEN 'purchase' THEN purchase END AS reached,
    CASE f.out WHEN 'error' THEN error WHEN 'signup' THEN signup END AS bad
  FROM nexts JOIN funnels f ON true JOIN LATERAL (VALUES (2, f.k1, f.k2), (3, f.k2, f.k3), (4, f.k3, f.k4)) k(step, own, next) ON k.own = nexts.kind
), good AS (
  SELECT client_id, funnel, step, ts, reached FROM moves WHERE reached <= ts + INTERVAL 15 MINUTES AND (bad IS NULL OR bad > reached)
), attempts AS (
  SELECT f.funnel, r.client_id, r.ts AS a1, s2.reached AS a2, s3.reached AS a3, s4.reached AS a4
  FROM steps_of r JOIN funnels f ON r.kind = f.k1
  LEFT JOIN good s2 ON s2.client_id = r.client_id AND s2.funnel = f.funnel AND s2.step = 2 AND s2.ts = r.ts
  LEFT JOIN good s3 ON s3.client_id = r.client_id AND s3.funnel = f.funnel AND s3.step = 3 AND s3.ts = s2.reached
  LEFT JOIN good s4 ON s4.client_id = r.client_id AND s4.funnel = f.funnel AND s4.step = 4 AND s4.ts = s3.reached
), counted AS (
  SELECT funnel, client_id, count(*) AS n1, count(a2) AS n2, count(a3) AS n3, count(a4) AS n4,
    list_sort(list(date_diff('microsecond', a1, a2)) FILTER (WHERE a2 IS NOT NULL))[(count(a2) + 1) // 2] AS t2,
    list_sort(list(date_diff('microsecond', a2, a3)) FILTER (WHERE a3 IS NOT NULL))[(count(a3) + 1) // 2] AS t3,
    list_sort(list(date_diff('microsecond', a3, a4)) FILTER (WHERE a4 IS NOT NULL))[(count(a4) + 1) // 2] AS t4
  FROM attempts GROUP BY funnel, client_id
), deep AS (
  SELECT *, CAST(CASE WHEN n4 > 0 THEN 4 WHEN n3 > 0 THEN 3 WHEN n2 > 0 THEN 2 ELSE 1 END AS INTEGER) AS deepest FROM counted
)
SELECT funnel, client_id, n1, n2, n3, n4, deepest, t2, t3, t4, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM deep
"""


def op13_anagram_spelling_groups(spark: SparkSession, root: str) -> DataFrame:
    from quern.llm.spelling import spelling_groups

    return spelling_groups(table(spark, root, "documents"))


#: crc32 byte by byte from its table; near words by equal rests after one deletion at one place.
OP13_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), counted AS (
  SELECT run, count(*) AS c, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS name FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run
), remainders AS (
  SELECT list(r ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda a, _: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS r FROM range(256) b(i))
), coded AS (
  SELECT run, c, hex(encode(name)) AS x FROM counted
), hashed AS (
  SELECT run, c, xor(list_reduce(list_concat([4294967295], list_transform(range(len(x) // 2), lambda i: 16 * instr('0123456789ABCDEF', x[2 * i + 1]) + instr('0123456789ABCDEF', x[2 * i + 2]) - 17)),
    lambda a, b: xor(a >> 8, t[CAST(xor(a % 256, b) AS BIGINT) + 1])), 4294967295) AS h
  FROM coded, remainders
), garbled AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, c FROM hashed
), words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM garbled WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), rests AS (
  SELECT word, place, substr(word, 1, place) || substr(word, place + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS place FROM words)
), pairs AS (
  SELECT a.word, b.word AS other FROM rests a JOIN rests b ON a.place = b.place AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT r.word, w.word FROM rests r JOIN words w ON w.word = r.rest
  UNION SELECT w.word, r.word FROM rests r JOIN words w ON w.word = r.rest
), ranked AS (
  SELECT p.word, p.other, o.n AS other_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY o.n DESC, encode(p.other)) AS place
  FROM pairs p JOIN words o ON o.word = p.other
), forms AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= 2 * w.n THEN r.other END AS form, CASE WHEN r.other_n >= 2 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
), ways(word, root, step) AS (
  SELECT word, word, 0 FROM forms UNION ALL SELECT ways.word, forms.form, ways.step + 1 FROM ways JOIN forms ON forms.word = ways.root WHERE forms.form IS NOT NULL
), roots AS (
  SELECT word, arg_max(root, step) AS root FROM ways GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""


QUERIES = {f.__name__: f for f in (op1_suffix_automaton_dedup, op2_log_bilinear_scores, op3_html_main_text, op4_best_fit_packing, op5_pivot_permutation_links, op6_nbsvm_quality, op7_jump_sharding, op8_pivotal_mixing, op9_token_combination_join, op10_small_world_search, op11_deficit_round_robin_packing, op12_backward_fill_funnels, op13_anagram_spelling_groups)}
ORACLES: dict[str, str] = {"op1_suffix_automaton_dedup": OP1_SQL, "op5_pivot_permutation_links": OP5_SQL, "op9_token_combination_join": OP9_SQL, "op12_backward_fill_funnels": OP12_SQL, "op13_anagram_spelling_groups": OP13_SQL}
