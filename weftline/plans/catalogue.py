"""The registered queries of the engine's own operators, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import storage
from weftline.functions import arrays, text
from weftline.operators import blocks, metrics, pairs, splits, vectors, vocab
from weftline.plans import config, corpora

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Parts of the SQL
WORDS = r"regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')"
LOWER = r"regexp_extract_all(lower(text), '[^ \t\n\r\f\x0B]+')"


def toks(words: str = WORDS, source: str = "documents", doc: str = "doc_id") -> str:
    return f"SELECT doc, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT {doc} AS doc, {words} AS w FROM {source})"


def first_seen(least: int, offset: int = 0, name: str = "t") -> str:
    return f"""SELECT word, row_number() OVER (ORDER BY first) - 1 + {offset} AS id, freq FROM (
      SELECT word, count(*) AS freq, min(doc * 1000000 + pos) AS first FROM {name} GROUP BY word) WHERE freq >= {least}"""


def most_common(k: int, offset: int, name: str = "t") -> str:
    return f"""SELECT word, row_number() OVER (ORDER BY freq DESC, first) - 1 + {offset} AS id, freq FROM (
      SELECT word, count(*) AS freq, min(doc * 1000000 + pos) AS first FROM {name} GROUP BY word) ORDER BY freq DESC, first LIMIT {k}"""


def padded(ids: str, n: int) -> str:
    return f"list_concat({ids}[1:{n}], list_transform(range(greatest(0, {n} - len({ids}))), lambda z: 0))"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.table(spark, sf_dir, "documents")


# Vocabularies


@query(f"WITH t AS ({toks()}) SELECT word, id::BIGINT AS id, freq FROM ({first_seen(3)})")
def vocab_first_seen(spark, sf_dir):
    d = docs(spark, sf_dir)
    return vocab.fit_vocab(vocab.tokens(d, corpora.words_of(d)), config.POLICIES["word2vec"])


@query(f"WITH t AS ({toks(LOWER)}) SELECT word, id::BIGINT AS id, freq FROM ({most_common(4998, 2)})")
def vocab_top_k(spark, sf_dir):
    d = docs(spark, sf_dir)
    return vocab.fit_vocab(vocab.tokens(d, corpora.words_of(d, True)), config.POLICIES["lm_words"])


GRAMS = f"""w AS (SELECT doc_id, {LOWER} AS w FROM documents),
g AS (SELECT doc_id, flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(0, least(2, i)), lambda j: array_to_string(w[i - j:i], ' ')))) AS g FROM w),
t AS (SELECT doc_id AS doc, unnest(g) AS word, generate_subscripts(g, 1) - 1 AS pos FROM g),
v AS (SELECT word, row_number() OVER (ORDER BY contains(word, ' '), first) + 1 AS id, freq, NOT contains(word, ' ') AS single FROM (
  SELECT word, count(*) AS freq, min(doc * 1000000 + pos) AS first FROM t GROUP BY word) WHERE freq >= 3)"""


@query(f"WITH {GRAMS} SELECT word, id::BIGINT AS id, freq, single FROM v")
def vocab_ngram_two_phase(spark, sf_dir):
    d = docs(spark, sf_dir)
    return vocab.fit_ngram_vocab(d, corpora.words_of(d, True), 2, 3)


CHARS = r"string_split(regexp_replace(text, '[ \t\n\r\f\x0B]+', '', 'g'), '')"


@query(f"WITH c AS (SELECT doc_id AS doc, {CHARS} AS c FROM documents), t AS (SELECT doc, unnest(c) AS word, generate_subscripts(c, 1) - 1 AS pos FROM c) "
       f"SELECT word, id::BIGINT AS id, freq FROM ({most_common(509, 3)})")
def char_vocab(spark, sf_dir):
    return corpora.char_vocab(docs(spark, sf_dir), config.POLICIES["lm_chars"])


@query(f"""WITH t AS ({toks()}), c AS (SELECT word, count(*) AS freq FROM t GROUP BY word)
SELECT (SELECT count(*) FROM t) AS n_tokens, (SELECT count(DISTINCT doc) FROM t) AS n_docs, count(*) AS n_words, count(*) FILTER (freq >= 3) AS n_kept_words, (sum(freq) FILTER (freq >= 3))::BIGINT AS n_kept_tokens FROM c""")
def vocab_totals(spark, sf_dir):
    d = docs(spark, sf_dir)
    return vocab.vocab_totals(vocab.tokens(d, corpora.words_of(d)), 3)


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'))::BIGINT AS n_tokens, len(string_split(text, chr(10)))::BIGINT AS n_lines, md5(replace(replace(text, chr(10) || chr(10), '. '), chr(10), '. ')) AS stops_md5, md5(lower(text)) AS lower_md5 FROM documents")
def text_functions(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.size(text.tokenize(t)).cast("long").alias("n_tokens"), F.size(text.split_on(t, "\n")).cast("long").alias("n_lines"), F.md5(text.newlines_to_stops(t)).alias("stops_md5"), F.md5(text.lower(t)).alias("lower_md5"))


# Encoding

ENCODED = "SELECT t.doc, list(coalesce(v.id, 1) ORDER BY t.pos) AS ids FROM t LEFT JOIN v USING (word) GROUP BY t.doc"


@query(f"WITH t AS ({toks()}), v AS ({first_seen(20, 2)}), e AS ({ENCODED}), d AS (SELECT doc_id AS doc, coalesce(ids, []) AS ids FROM documents LEFT JOIN e ON doc = doc_id) "
       f"SELECT doc, array_to_string({padded('ids', 100)}, ',') AS ids FROM d")
def encode_pad(spark, sf_dir):
    got = corpora.encoded(docs(spark, sf_dir), vocab.VocabPolicy("first_seen", 20, None, ("<pad>", "<unk>")), 100)
    return got.select("doc", arrays.text_of(F.col("ids")).alias("ids"))


PARALLEL = r"""p AS (
  SELECT u.conv_id, u.turn, regexp_extract_all(u.text, '[^ \t\n\r\f\x0B]+') AS src, regexp_extract_all(a.text, '[^ \t\n\r\f\x0B]+') AS tgt
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant' AND length(u.text) > 0 AND length(a.text) > 0 AND u.text[1] <> '<' AND a.text[1] <> '<'),
q AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS row FROM p WHERE len(src) <= 100 AND len(tgt) <= 100)"""


@query(f"WITH {PARALLEL} SELECT row, array_to_string(src, ' ') AS src, array_to_string(tgt, ' ') AS tgt FROM q")
def parallel_pairs(spark, sf_dir):
    return corpora.parallel_turns(storage.table(spark, sf_dir, "conversations")).select("row", text.join_words(F.col("src")).alias("src"), text.join_words(F.col("tgt")).alias("tgt"))


def _side(name: str) -> str:
    return f"""{name}t AS (SELECT row AS doc, unnest({name}) AS word, generate_subscripts({name}, 1) - 1 AS pos FROM q), {name}v AS ({most_common(29996, 4, name + 't')}),
{name}e AS (SELECT t.doc, list(coalesce(v.id, 1) ORDER BY t.pos) AS ids FROM {name}t t LEFT JOIN {name}v v USING (word) GROUP BY t.doc)"""


@query(f"""WITH {PARALLEL}, {_side('src')}, {_side('tgt')},
b AS (SELECT q.row, coalesce(s.ids, []) AS s, list_concat(coalesce(t.ids, [])[1:99], [3]) AS t FROM q LEFT JOIN srce s ON s.doc = row LEFT JOIN tgte t ON t.doc = row),
c AS (SELECT row, list_reverse({padded('s', 100)}) AS src, {padded('t', 100)} AS tgt FROM b)
SELECT row, array_to_string(src, ',') AS src, array_to_string(list_concat([2], tgt[1:99]), ',') AS tgt_in, array_to_string(tgt, ',') AS tgt FROM c""")
def nmt_encode(spark, sf_dir):
    rows, _, _ = corpora.translation_rows(corpora.parallel_turns(storage.table(spark, sf_dir, "conversations")))
    return rows.select("row", *[arrays.text_of(F.col(c)).alias(c) for c in ("src", "tgt_in", "tgt")])


@query(f"WITH w AS (SELECT doc_id, {LOWER} AS w FROM documents) SELECT doc_id, len(g)::BIGINT AS n, md5(array_to_string(g, '|')) AS grams_md5 FROM ("
       "SELECT doc_id, flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(0, least(3, i)), lambda j: array_to_string(w[i - j:i], ' ')))) AS g FROM w)")
def ngram_bag(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select("doc_id", arrays.backward_ngrams(corpora.words_of(d, True), 3).alias("g")).select("doc_id", F.size("g").cast("long").alias("n"), F.md5(F.array_join("g", "|")).alias("grams_md5"))


@query(f"""WITH {GRAMS}, u AS (SELECT coalesce(max(id) FILTER (single), 1) + 1 AS n FROM v),
e AS (SELECT t.doc, list(CASE WHEN contains(t.word, ' ') THEN coalesce(v.id, 1) % 100000 + u.n ELSE coalesce(v.id, 1) END ORDER BY t.pos) AS ids FROM t LEFT JOIN v USING (word), u GROUP BY t.doc)
SELECT doc, array_to_string({padded('ids', 100)}, ',') AS ids FROM e""")
def ngram_hash(spark, sf_dir):
    return corpora.ngram_rows(docs(spark, sf_dir)).select("doc", arrays.text_of(F.col("ids")).alias("ids"))


@query(f"""SELECT doc_id, p - 1 AS pos, strpos('{config.ALPHABET}', substr(t, p, 1)) - 1 AS idx FROM (SELECT doc_id, lower(text) AS t FROM documents), unnest(range(1, least(1014, length(t)) + 1)) AS r(p)
WHERE strpos('{config.ALPHABET}', substr(t, p, 1)) > 0""")
def char_onehot_sparse(spark, sf_dir):
    cells = arrays.one_hot(text.chars(F.lower("text")), config.ALPHABET, config.CharCNN().length)
    return docs(spark, sf_dir).select("doc_id", F.explode(cells).alias("x")).select("doc_id", F.col("x.pos").cast("long").alias("pos"), F.col("x.idx").cast("long").alias("idx"))


@query(f"""WITH {PARALLEL}, {_side('tgt')}
SELECT row, array_to_string(CASE WHEN list_position(ids, 7) IS NULL OR list_position(ids, 7) = 0 THEN ids ELSE ids[1:list_position(ids, 7) - 1] END, ',') AS cut,
       array_to_string(list_filter(ids, lambda z: z NOT IN (5, 6)), ',') AS cleaned FROM (SELECT doc AS row, ids FROM tgte)""")
def decode_cut(spark, sf_dir):
    """Cutting at a mark (here id 7 stands for the end mark) and dropping marks (5 and 6)."""
    both = corpora.parallel_turns(storage.table(spark, sf_dir, "conversations")).select(F.col("row").alias("doc_id"), F.col("tgt").alias("w"))
    v = storage.materialize(vocab.fit_vocab(vocab.tokens(both, F.col("w")), config.POLICIES["translator"]), "vocab")
    ids = vocab.encode(both, F.col("w"), v).where(F.size("ids") > 0)
    moved = F.transform("ids", lambda x: F.when(x == 7, arrays.END).otherwise(x))
    return ids.select(F.col("doc").alias("row"), arrays.text_of(arrays.until_end(moved)).alias("cut"), arrays.text_of(arrays.without(F.col("ids"), 5, 6)).alias("cleaned"))


@query(f"WITH {PARALLEL} SELECT row, array_to_string(tgt, ' ') AS words FROM q WHERE len(tgt) > 0")
def decode_words(spark, sf_dir):
    """Ids back to words: encoding and decoding with the whole vocabulary gives the words again."""
    both = corpora.parallel_turns(storage.table(spark, sf_dir, "conversations")).select(F.col("row").alias("doc_id"), F.col("tgt").alias("w"))
    v = storage.materialize(vocab.fit_vocab(vocab.tokens(both, F.col("w")), vocab.VocabPolicy("frequency", 1, None, ("<pad>", "<unk>", "<start>", "<end>"))), "vocab")
    return vocab.decode(vocab.encode(both, F.col("w"), v), v).select(F.col("doc").alias("row"), text.join_words(F.col("words")).alias("words"))


# Pairs

IDS = "i AS (SELECT t.doc, t.pos, v.id FROM t LEFT JOIN v USING (word))"


def _pairs(source: str, reach: int) -> str:
    one = [f"SELECT id AS a, lead(id, {k}) OVER (PARTITION BY doc ORDER BY pos) AS b FROM {source}" for k in range(1, reach + 1)]
    return " UNION ALL ".join(f"SELECT a AS center, b AS ctx FROM ({q}) UNION ALL SELECT b, a FROM ({q})" for q in one)


@query(f"WITH t AS ({toks()}), v AS ({first_seen(config.Word2Vec().min_count)}), {IDS}, g AS (SELECT * FROM i WHERE id IS NOT NULL), p AS ({_pairs('g', config.Word2Vec().window)}) SELECT center, ctx, count(*) AS n FROM p WHERE center IS NOT NULL AND ctx IS NOT NULL GROUP BY ALL")
def skipgram_pairs(spark, sf_dir):
    return corpora.skipgram_pairs(docs(spark, sf_dir))


@query(f"WITH t AS ({toks()}), v AS ({first_seen(20)}), {IDS}, p AS ({_pairs('i', 2)}) SELECT center AS w_id, ctx AS c_id, count(*)::DOUBLE AS x, round(least(1.0, pow(count(*) / 100.0, 0.75::DOUBLE)), 9) AS weight FROM p WHERE center IS NOT NULL AND ctx IS NOT NULL GROUP BY ALL")
def cooccurrence(spark, sf_dir):
    return corpora.glove_cells(docs(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


NOISE = f"WITH t AS ({toks()}), v AS ({first_seen(config.Word2Vec().min_count)})"


@query(f"{NOISE} SELECT id, freq, round(pow(freq, 0.75::DOUBLE) / sum(pow(freq, 0.75::DOUBLE)) OVER (), 12) AS p, round_even(round(pow(freq, 0.75::DOUBLE) / sum(pow(freq, 0.75::DOUBLE)) OVER (), 15) * 1000000, 0)::BIGINT AS slots FROM v")
def neg_distribution(spark, sf_dir):
    d = docs(spark, sf_dir)
    v = storage.materialize(vocab.fit_vocab(vocab.tokens(d, corpora.words_of(d)), config.POLICIES["word2vec"]), "vocab")
    return pairs.noise(v, slots=1_000_000).withColumn("p", F.round("p", 12))


def _windows(source: str, reach: int) -> str:
    """doc, pos, distance, center, ctx of all pairs within reach."""
    one = [f"SELECT doc, pos, {k} AS k, id AS a, lead(id, {k}) OVER (PARTITION BY doc ORDER BY pos) AS b FROM {source}" for k in range(1, reach + 1)]
    return " UNION ALL ".join(f"SELECT doc, pos, k AS distance, a AS center, b AS ctx FROM ({q}) WHERE b IS NOT NULL UNION ALL SELECT doc, pos + k, -k, b, a FROM ({q}) WHERE b IS NOT NULL" for q in one)


SLOTS = "d AS (SELECT id, round_even(pow(freq, 0.75::DOUBLE) / sum(pow(freq, 0.75::DOUBLE)) OVER () * 100000000, 0)::BIGINT AS slots FROM v)"


@query(f"""{NOISE}, {SLOTS}, c AS (SELECT id, sum(slots) OVER (ORDER BY id)::BIGINT - slots AS at FROM d WHERE slots > 0), {IDS},
g AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY pos) - 1 AS pos, id FROM i WHERE id IS NOT NULL),
w AS ({_windows('g', config.Word2Vec().window)}),
u AS (SELECT center, ctx, ('0x' || substr(md5('1-' || doc || '-' || pos || '-' || distance || '-' || k), 1, 15))::BIGINT % (SELECT sum(slots)::BIGINT FROM d) AS at FROM w, unnest(range(1, {config.Word2Vec().negatives} + 1)) AS r(k))
SELECT center, ctx, c.id AS neg FROM u ASOF JOIN c ON u.at >= c.at""")
def negative_samples(spark, sf_dir):
    """Three draws for each occurrence of a skip-gram pair."""
    cfg = config.Word2Vec()
    v, ids = corpora.word_lists(docs(spark, sf_dir), config.POLICIES["word2vec"])
    return pairs.list_negatives(ids, pairs.noise(v), cfg.window, cfg.negatives)


# the list of nodes is the state of the recursion: (frequency, place, node), the two rarest first
HUFFMAN = f"""t AS ({toks()}), v AS ({first_seen(config.POLICIES["word2vec_tree"].min_count)}),
s AS (SELECT count(*) AS n, list_sort(list({{'f': freq::BIGINT, 'p': id::BIGINT, 'x': id::BIGINT}})) AS q FROM v),
h(k, n, q, l, r) AS (SELECT 0::BIGINT, n, q, NULL::BIGINT, NULL::BIGINT FROM s UNION ALL
  SELECT k + 1, n, list_sort(list_append(q[3:], {{'f': q[1].f + q[2].f, 'p': -1 - k, 'x': n + k}})), CASE WHEN q[1].f = q[2].f THEN q[1].x ELSE q[2].x END, CASE WHEN q[1].f = q[2].f THEN q[2].x ELSE q[1].x END FROM h WHERE len(q) > 1),
up AS MATERIALIZED (SELECT l AS child, n + k - 1 AS parent, 1 AS bit FROM h WHERE k > 0 UNION ALL SELECT r, n + k - 1, 0 FROM h WHERE k > 0),
y(word_id, spot, code, path) AS (SELECT id, id, []::INTEGER[], []::BIGINT[] FROM v UNION ALL SELECT word_id, parent, list_prepend(bit, code), list_prepend(parent, path) FROM y JOIN up ON child = spot),
paths AS MATERIALIZED (SELECT * FROM y WHERE spot NOT IN (SELECT child FROM up))"""


@query(f"""WITH RECURSIVE {HUFFMAN}
SELECT word_id, array_to_string(code, ',') AS code, array_to_string(path, ',') AS path, array_to_string([p FOR p, i IN path IF code[i] = 1], ',') AS pos, array_to_string([p FOR p, i IN path IF code[i] = 0], ',') AS neg FROM paths""")
def huffman_paths(spark, sf_dir):
    d = docs(spark, sf_dir)
    v = storage.materialize(vocab.fit_vocab(vocab.tokens(d, corpora.words_of(d)), config.POLICIES["word2vec_tree"]), "vocab")
    return pairs.huffman_paths(v).select("word_id", *[arrays.text_of(F.col(c)).alias(c) for c in ("code", "path", "pos", "neg")])


@query(f"""WITH RECURSIVE {HUFFMAN}, {IDS}, g AS (SELECT * FROM i WHERE id IS NOT NULL), p AS (SELECT center, ctx, count(*) AS n FROM ({_pairs('g', config.Word2Vec().window)}) WHERE center IS NOT NULL AND ctx IS NOT NULL GROUP BY ALL)
SELECT center, path[k] AS node, code[k] AS sign, sum(n)::BIGINT AS n FROM p JOIN paths ON word_id = ctx, unnest(range(1, len(code) + 1)) AS r(k) GROUP BY ALL""")
def huffman_pairs(spark, sf_dir):
    v, ids = corpora.word_lists(docs(spark, sf_dir), config.POLICIES["word2vec_tree"])
    return pairs.path_counts(pairs.skipgram_counts(ids, config.Word2Vec().window), storage.materialize(pairs.huffman_paths(v), "paths"))


# Splits and batches

SPLIT = "CASE WHEN cum <= 1000000 THEN 'train' WHEN cum <= 1020000 THEN 'valid' ELSE 'test' END"


@query(f"""WITH n AS (SELECT doc_id, len({WORDS})::BIGINT AS n, sum(len({WORDS})) OVER (ORDER BY doc_id)::BIGINT AS cum FROM documents)
SELECT doc_id, n, cum, {SPLIT} AS split FROM n WHERE cum <= 1040000""")
def token_budget_split(spark, sf_dir):
    d = docs(spark, sf_dir)
    got = splits.budget_split(d.select("doc_id", F.size(corpora.words_of(d)).alias("n")), F.col("n"), [F.col("doc_id").asc()], config.CharWordLM().budgets)
    return got.select("doc_id", "n", "cum", "split")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('1-' || doc_id::VARCHAR), doc_id) - 1 AS row, count(*) OVER () AS n FROM documents),
b AS (SELECT *, 2 * n // 10 AS low, 3 * n // 10 AS high FROM r)
SELECT doc_id, row, CASE WHEN row >= low AND row < high THEN 'test' WHEN (CASE WHEN row < low THEN row ELSE row - (high - low) END) < floor(0.9::DOUBLE * (n - (high - low))) THEN 'train' ELSE 'valid' END AS split FROM b""")
def kfold_split(spark, sf_dir):
    return splits.k_fold(docs(spark, sf_dir).select("doc_id"), [splits.shuffle_key(F.col("doc_id"), 1).asc(), F.col("doc_id").asc()], 2).select("doc_id", "row", "split")


@query(f"""WITH r AS (SELECT doc_id, len({WORDS})::BIGINT AS length, row_number() OVER (ORDER BY len({WORDS}) DESC, doc_id) - 1 AS row FROM documents)
SELECT doc_id, length, row, row // 64 AS batch, max(length) OVER (PARTITION BY row // 64) AS batch_length FROM r""")
def len_sort_batches(spark, sf_dir):
    d = docs(spark, sf_dir)
    return splits.length_batches(d.select("doc_id", F.size(corpora.words_of(d)).alias("n")), F.col("n"), [F.col("doc_id").asc()], 64).select("doc_id", "length", "row", F.col("batch").cast("long").alias("batch"), "batch_length")


@query("""SELECT part, doc_id, row_number() OVER (ORDER BY part, doc_id) - 1 AS row, (row_number() OVER (ORDER BY part, doc_id) - 1) // 32 AS batch FROM (
SELECT CASE WHEN quality = 1 THEN 0 ELSE 1 END::BIGINT AS part, doc_id FROM labels)""")
def sample_concat_batches(spark, sf_dir):
    """Good and then bad samples as one ordered bag, in batches of 32."""
    labels = storage.table(spark, sf_dir, "labels")
    bag = splits.concat_samples(labels.where("quality = 1").select("doc_id"), labels.where("quality <> 1 OR quality IS NULL").select("doc_id"), order="doc_id")
    return splits.batches(bag, [F.col("part").asc(), F.col("doc_id").asc()], 32).select(F.col("part").cast("long").alias("part"), "doc_id", "row", F.col("batch").cast("long").alias("batch"))


@query(f"SELECT doc_id, len({WORDS})::BIGINT AS n FROM documents ORDER BY n DESC, doc_id LIMIT 20")
def head_rows(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.size(text.split_words(F.col("text"))).cast("long").alias("n"))
    return splits.head(d, [F.col("n").desc(), F.col("doc_id").asc()], 20)


@query()
def document_matrices(spark, sf_dir):
    got = corpora.document_matrices(docs(spark, sf_dir))
    return got.select("doc", "row", F.col("batch").cast("long").alias("batch"), F.size("sents").cast("long").alias("n_sents"), F.md5(arrays.text_of(F.flatten("sents"))).alias("ids_md5"))


ORACLES["document_matrices"] = f"""WITH r AS (SELECT doc_id, text, row_number() OVER (ORDER BY len({WORDS}) DESC, doc_id) - 1 AS row FROM documents),
t AS ({toks(WORDS, 'r', 'row')}), v AS ({first_seen(5, 2)}), l AS (SELECT row, string_split(text, chr(10)) AS s FROM r),
s AS (SELECT row, unnest(s) AS s, generate_subscripts(s, 1) AS sent FROM l), sw AS (SELECT row, sent, regexp_extract_all(s, '[^ \\t\\n\\r\\f\\x0B]+') AS w FROM s),
sx AS (SELECT row, sent, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM sw), si AS (SELECT row, sent, list(coalesce(v.id, 1) ORDER BY pos) AS ids FROM sx LEFT JOIN v USING (word) GROUP BY row, sent),
sp AS (SELECT sw.row, sw.sent, coalesce(si.ids, []) AS ids FROM sw LEFT JOIN si ON si.row = sw.row AND si.sent = sw.sent), d AS (SELECT row, list({padded('ids', 100)} ORDER BY sent) AS sents FROM sp GROUP BY row),
b AS (SELECT row, row // 64 AS batch, sents, max(len(sents)) OVER (PARTITION BY row // 64) AS most FROM d)
SELECT r.doc_id AS doc, b.row, b.batch, b.most::BIGINT AS n_sents, md5(array_to_string(list_concat(flatten(sents), list_transform(range(100 * (most - len(sents))), lambda z: 0)), ',')) AS ids_md5 FROM b JOIN r USING (row)"""


# Vectors


def _vectors(spark, sf_dir) -> DataFrame:
    return storage.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("word"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


@query("WITH x AS (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(*) AS n FROM x")
def vector_stats(spark, sf_dir):
    return vectors.component_stats(_vectors(spark, sf_dir)).select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("""WITH v AS (SELECT 'v' || (vec_id * 2)::VARCHAR AS word, vec_id AS id FROM embeddings), e AS (SELECT 'v' || vec_id::VARCHAR AS word, embedding FROM embeddings)
SELECT v.word, v.id, e.word IS NOT NULL AS pretrained, CASE WHEN e.word IS NOT NULL THEN round(list_sum(list_transform(embedding, lambda z: z::DOUBLE)), 4) END AS total FROM v LEFT JOIN e USING (word)""")
def pretrained_init(spark, sf_dir):
    """Words of which half have a vector; the others get seeded normal draws."""
    e = _vectors(spark, sf_dir)
    v = e.select(F.concat(F.lit("v"), (F.col("id") * 2).cast("string")).alias("word"), "id")
    got = vectors.initial_vectors(v, e.select("word", "vec"), 64)
    return got.select("word", "id", "pretrained", F.when(F.col("pretrained"), F.round(arrays.total(F.col("vec")), 4)).alias("total"))


@query("""WITH v AS (SELECT 'v' || (vec_id * 2)::VARCHAR AS word FROM embeddings), e AS (SELECT 'v' || vec_id::VARCHAR AS word FROM embeddings)
SELECT word, word IN (SELECT word FROM e) AS covered FROM v""")
def pretrained_coverage(spark, sf_dir):
    e = _vectors(spark, sf_dir)
    v = e.select(F.concat(F.lit("v"), (F.col("id") * 2).cast("string")).alias("word"), "id")
    return vectors.coverage(v, e).select("word", F.lit(True).alias("covered")).unionByName(vectors.missing(v, e).select("word", F.lit(False).alias("covered")))


@query("""WITH p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: x[i]::DOUBLE * y[i]::DOUBLE)), 4) AS dot, round(list_sum(list_transform(range(1, 65), lambda i: (x[i]::DOUBLE + y[i]::DOUBLE) / 2)), 4) AS mean_sum FROM p""")
def vector_dot_mean(spark, sf_dir):
    e = _vectors(spark, sf_dir)
    both = e.select("id", F.col("vec").cast("array<double>").alias("x")).join(e.select((F.col("id") - 1).alias("id"), F.col("vec").cast("array<double>").alias("y")), "id")
    return both.select(F.col("id").alias("vec_id"), F.round(arrays.dot(F.col("x"), F.col("y")), 4).alias("dot"), F.round(arrays.total(arrays.mean_of_two(F.col("x"), F.col("y"))), 4).alias("mean_sum"))


@query("""WITH i AS (SELECT label AS doc, list(vec_id ORDER BY vec_id) AS ids FROM embeddings GROUP BY label), f AS (SELECT doc, unnest(ids) AS vec_id FROM i),
x AS (SELECT doc, k, avg(embedding[k]::DOUBLE) AS m FROM f JOIN embeddings USING (vec_id), unnest(range(1, 65)) AS r(k) GROUP BY doc, k)
SELECT doc, round(sum(m), 4) AS total, round(max(m), 4) AS most FROM x GROUP BY doc""")
def vector_mean(spark, sf_dir):
    """Mean vectors of the labels' members by looking up rows of a block matrix."""
    e = _vectors(spark, sf_dir)
    matrix = blocks.Blocks(storage.materialize(blocks.Blocks.of(e, "id", "vec").table, "blocks"))
    got = matrix.means(e.select(F.col("label").alias("doc"), "id"), "doc", "id")
    return got.groupBy("doc").agg(F.round(F.sum("mean"), 4).alias("total"), F.round(F.max("mean"), 4).alias("most"))


@query("SELECT k - 1 AS col, round(sum(embedding[k]::DOUBLE), 4) AS total, count(*) AS n FROM embeddings, unnest(range(1, 65)) AS r(k) GROUP BY k")
def transpose(spark, sf_dir):
    """Sums of the rows of a transposed block matrix."""
    got = blocks.Blocks.of(_vectors(spark, sf_dir), "id", "vec").transpose().row_sums()
    return got.select(F.col("row").alias("col"), F.round("total", 4).alias("total"), "n")


# Functions of scores


@query("""WITH s AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda z: z::DOUBLE * 3) AS s FROM embeddings),
e AS (SELECT *, list_sum(list_transform(s, lambda z: exp(z))) AS z FROM s)
SELECT vec_id, round(exp(s[1]) / z, 6) AS p0, round(ln(z) - s[label % 10 + 1], 6) AS loss, (list_position(s, list_max(s)) - 1)::BIGINT AS best, round(greatest(s[1], 0), 6) AS relu0, round(tanh(s[1]), 6) AS tanh0,
       round(-ln(1 + exp(-greatest(-10.0, least(10.0, s[1])))), 6) AS log_sigmoid0, round(pow(s[1] - s[2], 2), 6) AS squared FROM e""")
def score_functions(spark, sf_dir):
    s = storage.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 10), lambda z: z.cast("double") * 3).alias("s"))
    c = F.col("s")
    return s.select(
        "vec_id", F.round(arrays.softmax(c)[0], 6).alias("p0"), F.round(arrays.cross_entropy(c, F.col("label") % 10), 6).alias("loss"), arrays.argmax(c).cast("long").alias("best"), F.round(arrays.relu(c)[0], 6).alias("relu0"),
        F.round(arrays.tanh(c)[0], 6).alias("tanh0"), F.round(arrays.log_sigmoid(arrays.clamp(c[0])), 6).alias("log_sigmoid0"), F.round(F.pow(c[0] - c[1], F.lit(2)), 6).alias("squared"),
    )


@query("""WITH s AS (SELECT vec_id, list_transform(embedding[1:8], lambda z: z::DOUBLE) AS s, list_transform(range(1, 9), lambda i: CASE WHEN i <= 1 + vec_id % 8 THEN 1 ELSE 0 END) AS m FROM embeddings),
p AS (SELECT vec_id, m, list_transform(range(1, 9), lambda i: CASE WHEN m[i] <> 0 THEN exp(s[i]) / list_sum(list_transform(s, lambda z: exp(z))) ELSE 0 END) AS p FROM s)
SELECT vec_id, round(p[1] / (list_sum(p) + 0.0001), 6) AS p0, round(list_sum(list_transform(p, lambda z: z / (list_sum(p) + 0.0001))), 6) AS total FROM p""")
def masked_attention(spark, sf_dir):
    e = storage.table(spark, sf_dir, "embeddings")
    mask = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (i <= 1 + F.col("vec_id") % 8).cast("int"))
    got = e.select("vec_id", arrays.masked_softmax(F.transform(F.slice("embedding", 1, 8), lambda z: z.cast("double")), mask).alias("a"))
    return got.select("vec_id", F.round(F.col("a")[0], 6).alias("p0"), F.round(arrays.total(F.col("a")), 6).alias("total"))


# Metrics


@query("SELECT avg((CASE WHEN length(text) % 2 = 0 THEN 1 ELSE 0 END = quality)::INT::DOUBLE) AS accuracy, count(*) AS n FROM labels JOIN documents USING (doc_id)")
def accuracy(spark, sf_dir):
    rows = storage.table(spark, sf_dir, "labels").join(docs(spark, sf_dir), "doc_id")
    return metrics.accuracy(rows, F.when(F.length("text") % 2 == 0, 1).otherwise(0), F.col("quality"))


@query("SELECT round(sum(value * (user_id % 3)) / count(*) FILTER (user_id % 3 <> 0), 6) AS loss FROM events")
def masked_loss(spark, sf_dir):
    return metrics.masked_mean_loss(storage.table(spark, sf_dir, "events"), F.col("value"), F.col("user_id") % 3).select(F.round("loss", 6).alias("loss"))


@query("SELECT round(avg(exp(m)), 6) AS perplexity, count(m) AS n_sentences FROM (SELECT sum(value / 100 * (event_id % 4 > 0)::INT) / nullif(count(*) FILTER (event_id % 4 > 0), 0) AS m FROM events GROUP BY user_id) WHERE m IS NOT NULL")
def perplexity(spark, sf_dir):
    rows = storage.table(spark, sf_dir, "events").where("event_id % 4 > 0")
    return metrics.perplexity(rows, "user_id", F.col("value") / 100, (F.col("event_id") % 4 > 0).cast("int")).select(F.round("perplexity", 6).alias("perplexity"), "n_sentences")


@query("SELECT round(sum(m), 4) AS loss FROM (SELECT avg(value) AS m FROM events GROUP BY event_id // 64)")
def batch_loss(spark, sf_dir):
    return metrics.summed_batch_loss(storage.table(spark, sf_dir, "events"), F.floor(F.col("event_id") / 64), F.col("value")).select(F.round("loss", 4).alias("loss"))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(sum(value * pow(0.95::DOUBLE, n - r) * CASE WHEN r = 1 THEN 1 ELSE 0.05::DOUBLE END), 6) AS ema, max(n) AS n FROM r GROUP BY user_id""")
def ema(spark, sf_dir):
    return metrics.moving_average(storage.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", F.round("ema", 6).alias("ema"), "n")


@query("SELECT event_id // 100 AS interval, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def interval_loss(spark, sf_dir):
    got = metrics.interval_means(storage.table(spark, sf_dir, "events"), F.col("event_id"), F.col("value"))
    return got.select(F.col("interval").cast("long").alias("interval"), F.round("mean", 6).alias("mean"), "n")


@query("""WITH RECURSIVE r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
f(user_id, r, best, counter, stop_at) AS (
  SELECT user_id, r, value, 0, NULL::BIGINT FROM r WHERE r = 1
  UNION ALL
  SELECT f.user_id, r.r, CASE WHEN r.value <= f.best THEN r.value ELSE f.best END, CASE WHEN r.value <= f.best THEN 0 ELSE f.counter + 1 END, CASE WHEN r.value > f.best AND f.counter + 1 >= 5 THEN r.r END
  FROM f JOIN r ON r.user_id = f.user_id AND r.r = f.r + 1 WHERE f.stop_at IS NULL)
SELECT user_id, arg_max(best, r) AS best, arg_max(counter, r)::BIGINT AS counter, max(stop_at) AS stop_at FROM f GROUP BY user_id""")
def early_stop(spark, sf_dir):
    return metrics.early_stops(storage.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 5)


def _bleu_sql(tail: str) -> str:
    return f"""WITH {PARALLEL}, n AS (SELECT unnest([1, 2, 3, 4]) AS n),
a AS (SELECT row, n, array_to_string(tgt[i:i + n - 1], chr(1)) AS g, count(*) AS c FROM q, n, unnest(range(1, len(tgt) - n + 2)) AS r(i) GROUP BY ALL),
b AS (SELECT row, n, array_to_string(src[i:i + n - 1], chr(1)) AS g, count(*) AS c FROM q, n, unnest(range(1, len(src) - n + 2)) AS r(i) GROUP BY ALL),
m AS (SELECT a.row, a.n, sum(least(a.c, coalesce(b.c, 0)))::BIGINT AS clipped, sum(a.c)::BIGINT AS total FROM a LEFT JOIN b ON a.row = b.row AND a.n = b.n AND a.g = b.g GROUP BY ALL)
{tail}"""


def _translated(spark, sf_dir) -> DataFrame:
    return corpora.parallel_turns(storage.table(spark, sf_dir, "conversations")).select("row", F.col("src").alias("ref"), F.col("tgt").alias("pred"))


@query(_bleu_sql("SELECT row, n::BIGINT AS n, clipped, total FROM m"))
def bleu_counts(spark, sf_dir):
    return metrics.ngram_matches(_translated(spark, sf_dir), "row").select("row", F.col("n").cast("long").alias("n"), "clipped", "total")


@query(_bleu_sql("""SELECT round(CASE WHEN (SELECT count(*) FROM (SELECT n FROM m GROUP BY n HAVING sum(clipped) > 0)) < 4 THEN 0 ELSE
  100 * exp(least(0, 1 - r::DOUBLE / c)) * exp((SELECT sum(ln(x)) / 4 FROM (SELECT sum(clipped)::DOUBLE / sum(total) AS x FROM m GROUP BY n) WHERE x > 0)) END, 6) AS bleu, c AS pred_words, r AS ref_words
  FROM (SELECT sum(len(tgt))::BIGINT AS c, sum(len(src))::BIGINT AS r FROM q)"""))
def bleu(spark, sf_dir):
    return metrics.corpus_bleu(_translated(spark, sf_dir), "row").withColumn("bleu", F.round("bleu", 6))


@query(f"SELECT max(len({WORDS}))::BIGINT AS most_words, max(length(text))::BIGINT AS most_chars, count(*) AS n FROM documents")
def length_stats(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.agg(F.max(F.size(corpora.words_of(d))).cast("long").alias("most_words"), F.max(F.length("text")).cast("long").alias("most_chars"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('7-' || doc_id::VARCHAR), doc_id) - 1 AS row, (row_number() OVER (ORDER BY md5('7-' || doc_id::VARCHAR), doc_id) - 1) // 50 AS batch FROM documents")
def shuffled_batches(spark, sf_dir):
    """One epoch of a shuffled loader; the epoch is the seed."""
    d = docs(spark, sf_dir).select("doc_id")
    return splits.batches(d, [splits.shuffle_key(F.col("doc_id"), 7).asc(), F.col("doc_id").asc()], 50).select("doc_id", "row", F.col("batch").cast("long").alias("batch"))
