"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import (
    exact_dedup,
    hamming_search,
    jaccard_join,
    packing,
    phrases,
    preference,
    sentencepiece,
    spelling,
    suffix_dedup,
    token_output,
    topk,
    toxicity,
    warc,
)
from quayside.llm.common import prepare, table
from quayside.session import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(fn):
    def run(spark, sf_dir):
        prepare(spark)
        return fn(spark, sf_dir)

    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


@query
def op1_sentencepiece(spark, sf_dir):
    """The four best segmentations of every document, decoded again."""
    return sentencepiece.encode(table(spark, sf_dir, "documents"), PIECES, n=4, with_ids=False)


@query
def op2_exact_dedup(spark, sf_dir):
    """Which of equal documents stays."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), hash_all=True)


@query
def op3_warc(spark, sf_dir):
    """All pages written as archives and read back."""
    archives = warc.write(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return warc.read(archives, with_payload=False)


def toxicity_model(spark, docs, sf_dir):
    """Grades from the labels: 0 not toxic, 1 toxic in a text of good quality, 2 toxic in a poor one."""
    grade = F.col("toxic") * (2 - F.col("quality"))
    return toxicity.fit_on(docs, table(spark, sf_dir, "labels"), grade)


@query
def op4_toxicity(spark, sf_dir):
    """Expected severity of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade_documents(docs, toxicity_model(spark, docs, sf_dir))


@query
def op5_suffix_dedup(spark, sf_dir):
    """What stays of every document without strings of 50 bytes that an earlier document has."""
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"), 50, with_text=False)


@query
def op6_jaccard_join(spark, sf_dir):
    """Groups of documents linked by 90 % of their three-word shingles."""
    return jaccard_join.groups(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


@query
def op7_token_output(spark, sf_dir):
    """Token ids of all documents written as compressed arrays and read back."""
    folder = scratch(spark, "tokens")
    shards = token_output.write(table(spark, sf_dir, "documents"), folder, TOKENIZER)
    return token_output.read(shards, folder, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op8_preference(spark, sf_dir):
    """Every conversation against itself with the last reply of the next one. The masks are the spans of characters that are
    trained on, as start-end."""
    conversations = preference.as_arrays(table(spark, sf_dir, "conversations"))
    made = preference.pairs(preference.with_other_reply(conversations))
    columns = {}
    for side in ("chosen", "rejected"):
        spans = F.col(f"{side}_spans")
        columns[f"{side}_mask"] = F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
        columns[f"{side}_trained"] = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return made.withColumns(columns).withColumnRenamed("id", "conv_id").drop("chosen_spans", "rejected_spans")


@query
def op9_packing(spark, sf_dir):
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, with_tokens=False)


@query
def op10_topk(spark, sf_dir):
    """The 20 best partners of every vector whose id is divisible by 20."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op11_spelling(spark, sf_dir):
    """Near words of every word, with one run in 97 misspelt."""
    return spelling.variants(table(spark, sf_dir, "documents"), 5, 3, 2, delete_every=97)


@query
def op12_hamming_search(spark, sf_dir):
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return hamming_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op13_phrases(spark, sf_dir):
    """The 2,000 first collocations of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"), least=30, top=2000)


def _completion(side: str) -> str:
    """SQL for one side's text behind the prompt, its mask, and how many characters of it are trained on."""
    return f"""{side}_laid AS (
        SELECT conv_id, i, role, text, coalesce(sum(length(role) + length(text) + 13) OVER (
                   PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + 5 AS a
        FROM {side} JOIN prompted USING (conv_id) WHERE i > prompt_turns),
      {side}_done AS (
        SELECT conv_id, string_agg('<|' || role || '|>\n' || text || '<|end|>\n', '' ORDER BY i) AS body,
               string_agg(a::BIGINT || '-' || (a + length(text) + 7)::BIGINT, ',' ORDER BY i) FILTER (role = 'assistant') AS mask,
               sum(length(text) + 7) FILTER (role = 'assistant') AS trained FROM {side}_laid GROUP BY conv_id)"""


ORACLE = {
    "op8_preference": f"""
        WITH t AS (SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
      chosen AS (SELECT conv_id, role, text, row_number() OVER (
                     PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
      replies AS (SELECT conv_id, max(i) AS place, arg_max(text, i) AS reply FROM chosen WHERE role = 'assistant' GROUP BY conv_id),
      swaps AS (SELECT r.conv_id, r.place, o.reply AS other FROM replies r LEFT JOIN replies o ON o.conv_id = r.conv_id + 1),
      rejected AS (
        SELECT conv_id, role, CASE WHEN i = place THEN other ELSE text END AS text, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS i
        FROM chosen LEFT JOIN swaps USING (conv_id) WHERE place IS NULL OR i <> place OR other IS NOT NULL),
      prompted AS (
        SELECT c.conv_id, coalesce(min(c.i) FILTER (r.i IS NULL OR r.role <> c.role OR r.text <> c.text) - 1, max(c.i))::INTEGER AS prompt_turns
        FROM chosen c LEFT JOIN rejected r ON r.conv_id = c.conv_id AND r.i = c.i GROUP BY c.conv_id),
      prompts AS (
        SELECT conv_id, string_agg('<|' || role || '|>\n' || text || '<|end|>\n', '' ORDER BY i) AS prompt
        FROM chosen JOIN prompted USING (conv_id) WHERE i <= prompt_turns GROUP BY conv_id),
      {_completion('chosen')}, {_completion('rejected')}
      SELECT conv_id, prompt_turns, coalesce(prompt, '') AS prompt, coalesce(c.body, '') AS chosen, coalesce(r.body, '') AS rejected,
             coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask, coalesce(c.trained, 0)::BIGINT AS chosen_trained,
             coalesce(r.trained, 0)::BIGINT AS rejected_trained
      FROM prompted LEFT JOIN prompts USING (conv_id) LEFT JOIN chosen_done c USING (conv_id) LEFT JOIN rejected_done r USING (conv_id)""",
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op10_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_spelling": """
        WITH RECURSIVE crc AS (
            SELECT list(c ORDER BY i) AS tab FROM (
                SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
                                      lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c FROM range(256) t(i))),
        runs AS (SELECT doc_id, run, count(*) AS times FROM (
                SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
                FROM documents) GROUP BY ALL HAVING length(run) >= 5),
        bytes AS (SELECT *, flatten(list_transform(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: ord(x)),
                         lambda o: CASE WHEN o < 128 THEN [o] ELSE [192 + o // 64, 128 + o % 64] END)) AS b FROM runs),
        hashed AS (SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b::BIGINT[]),
                         lambda c, x: xor(tab[(xor(c, x) % 256) + 1], c // 256))) AS h FROM bytes, crc),
        words AS (SELECT word, sum(times)::BIGINT AS n FROM (
                SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed)
                GROUP BY word HAVING length(word) >= 5 AND sum(times) >= 3),
        holes AS (SELECT word, n, i, left(word, i) AS x, substr(word, i + 2) AS y FROM words, range(0, 100) r(i) WHERE i < length(word)),
        pairs AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM holes a JOIN holes b USING (x, y) WHERE a.word <> b.word
                  UNION SELECT a.word, a.n, b.word, b.n FROM holes a JOIN words b ON b.word = a.x || a.y
                  UNION SELECT b.word, b.n, a.word, a.n FROM holes a JOIN words b ON b.word = a.x || a.y),
        best AS (SELECT word, count(*) OVER w AS n_near, first_value(other) OVER (w ORDER BY m DESC, other) AS other, max(m) OVER w AS m, n
                 FROM pairs WINDOW w AS (PARTITION BY word)),
        form AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 2 * w.n THEN b.other END AS form,
                        CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n
                 FROM words w LEFT JOIN (SELECT DISTINCT word, n_near, other, m FROM best) b USING (word)),
        walk AS (SELECT word, word AS at FROM form UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON form.word = walk.at WHERE form.form IS NOT NULL)
        SELECT form.word, form.form, walk.at AS root, form.n, form.n_near, form.form_n
        FROM form JOIN walk USING (word) JOIN form AS last ON last.word = walk.at WHERE last.form IS NULL""",
    "op13_phrases": r"""
        WITH p AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
                          unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda x: x <> '') AS w FROM p),
        g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_aggregate(w[i:i + k - 1], 'string_agg', ' '))) AS phrase
              FROM w, range(1, 5) r(k)),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
        t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
        o AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c d ON d.lang = c.lang AND d.k > c.k AND 100 * d.a::HUGEINT >= 80 * c.a::HUGEINT
              AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ')),
        u AS (SELECT lang, k, phrase, a, cut, list_aggregate(w[1:cut], 'string_agg', ' ') AS x, list_aggregate(w[cut + 1:k], 'string_agg', ' ') AS y
              FROM c ANTI JOIN o USING (lang, phrase), range(1, 4) r(cut) WHERE cut < k),
        s AS (SELECT u.lang, u.phrase, a, cut, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score
              FROM u JOIN f l ON l.lang = u.lang AND l.phrase = x JOIN f r ON r.lang = u.lang AND r.phrase = y),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
        SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN t USING (lang) WHERE rank <= 2000""",
}
