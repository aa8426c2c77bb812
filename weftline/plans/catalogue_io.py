"""Registered queries of sources and sinks (written and read again), kernels, training and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import storage
from weftline.functions import arrays, text
from weftline.models import boost, kernels, train
from weftline.operators import metrics, pairs, ranking, splits, vocab
from weftline.plans import config, corpora
from weftline.plans.catalogue import ORACLES, PARALLEL, SPLIT, WORDS, docs, first_seen, query, toks
from weftline.sources import readers, writers
from weftline.streaming import folds, timed

# Sources


def _text_file(df: DataFrame, value: F.Column, name: str) -> str:
    at = storage.new_path(df.sparkSession, name)
    df.orderBy("doc_id").select(value.alias("value")).write.text(at)  # files that follow one another
    return at


FLAT = "regexp_replace(text, '[\\n\\r]+', ' ', 'g')"


def flat(c: str = "text") -> F.Column:
    return F.regexp_replace(c, "[\n\r]+", " ")


@query(f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, len(regexp_extract_all({FLAT}, '[^ \\t\\n\\r\\f\\x0B]+'))::BIGINT AS n, md5({FLAT}) AS md5 FROM documents")
def source_lines(spark, sf_dir):
    at = _text_file(docs(spark, sf_dir), flat(), "lines")
    return readers.lines(spark, at).select("line_no", F.size(text.split_words(F.col("text"))).cast("long").alias("n"), F.md5("text").alias("md5"))


@query("SELECT md5(text) AS md5, count(*) AS n FROM documents GROUP BY 1")
def source_json_lines(spark, sf_dir):
    d = docs(spark, sf_dir)
    at = _text_file(d, F.to_json(F.struct("text")), "json")
    return readers.json_lines(spark, at).groupBy(F.md5("text").alias("md5")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS label, count(*) AS n, sum(length(source || ' ' || text))::BIGINT AS chars FROM documents GROUP BY 1")
def source_labelled_csv(spark, sf_dir):
    """Quoted CSV with line ends and quotes in fields: label from 1, title, body."""
    d = docs(spark, sf_dir)
    label = F.when(F.col("lang") == "de", 1).when(F.col("lang") == "en", 2).when(F.col("lang") == "es", 3).otherwise(4)
    at = storage.new_path(spark, "csv")
    d.select(label.alias("l"), "source", "text").write.csv(at, quote='"', escape='"', quoteAll=True)
    return readers.labelled_csv(spark, at).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"SELECT (doc_id % 10)::INT AS label, count(*) AS n, sum(length({FLAT}))::BIGINT AS chars FROM documents GROUP BY 1")
def source_double_tab(spark, sf_dir):
    d = docs(spark, sf_dir)
    at = _text_file(d, F.concat_ws("\t\t", F.lit("user"), F.col("doc_id").cast("string"), (F.col("doc_id") % 10 + 1).cast("string"), flat()), "tabs")
    return readers.double_tab(spark, at).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"SELECT CASE WHEN quality = 1 THEN 1 ELSE 0 END AS label, count(*) AS n, sum(length({FLAT}))::BIGINT AS chars FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def source_labelled_files(spark, sf_dir):
    d = storage.table(spark, sf_dir, "labels").join(docs(spark, sf_dir), "doc_id")
    paths = {k: _text_file(d.where(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0)) == k), flat(), f"class{k}") for k in (0, 1)}
    return readers.labelled_by_file(spark, paths).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, length({FLAT})::BIGINT AS n_src, lang AS tgt FROM documents")
def source_parallel_files(spark, sf_dir):
    d = docs(spark, sf_dir)
    got = readers.parallel_files(spark, _text_file(d, flat(), "src"), _text_file(d, F.col("lang"), "tgt"))
    return got.select("line_no", F.length("src").cast("long").alias("n_src"), "tgt")


# Sinks


def _matrix(spark, sf_dir) -> DataFrame:
    return storage.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("word"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


@query("SELECT 'v' || vec_id::VARCHAR AS word, len(embedding)::BIGINT AS dim, round(list_sum(list_transform(embedding, lambda z: z::DOUBLE)), 6) AS total FROM embeddings")
def sink_embeddings_text(spark, sf_dir):
    at = storage.new_path(spark, "vectors")
    writers.write_embeddings(_matrix(spark, sf_dir), at)
    return readers.text_vectors(spark, at).select("word", F.size("vec").cast("long").alias("dim"), F.round(arrays.total(F.col("vec")), 6).alias("total"))


@query("SELECT 'v' || vec_id::VARCHAR AS word, len(embedding)::BIGINT AS dim, round(list_sum(list_transform(embedding, lambda z: z::DOUBLE)), 4) AS total FROM embeddings")
def source_binary_vectors(spark, sf_dir):
    """Binary vectors, written by one task for each part of the table."""
    cols = _matrix(spark, sf_dir).select("word", "vec")

    def encode(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch([pa.array([writers.binary_embeddings(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))], pa.binary())], ["content"])

    blobs = storage.materialize(cols.mapInArrow(encode, "content binary"), "blobs")

    def decode(batches):
        for b in batches:
            yield from readers.parse_binary(b.column(0).to_pylist())

    got = blobs.mapInArrow(decode, "word string, vec array<float>")
    return got.select("word", F.size("vec").cast("long").alias("dim"), F.round(arrays.total(F.transform("vec", lambda x: x.cast("double"))), 4).alias("total"))


@query(f"""WITH n AS (SELECT doc_id, len({WORDS})::BIGINT AS n, sum(len({WORDS})) OVER (ORDER BY doc_id)::BIGINT AS cum FROM documents)
SELECT {SPLIT} AS split, count(*) AS docs, sum(n)::BIGINT AS tokens FROM n WHERE cum <= 1040000 GROUP BY 1""")
def sink_splits(spark, sf_dir):
    d = docs(spark, sf_dir)
    got = splits.budget_split(d.select("doc_id", F.size(corpora.words_of(d)).alias("n")), F.col("n"), [F.col("doc_id").asc()], config.CharWordLM().budgets)
    at = storage.new_path(spark, "splits")
    writers.write_splits(got, at)
    return spark.read.parquet(at).groupBy("split").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"))


@query(ORACLES["cooccurrence"].replace("SELECT center AS w_id, ctx AS c_id, count(*)::DOUBLE AS x, round(least(1.0, pow(count(*) / 100.0, 0.75::DOUBLE)), 9) AS weight", "SELECT center AS w_id, ctx AS c_id, count(*)::DOUBLE AS x"))
def sink_cells(spark, sf_dir):
    """Co-occurrence cells written in row-major order and read again."""
    at = storage.new_path(spark, "cells")
    writers.write_cells(corpora.glove_cells(docs(spark, sf_dir)).select("w_id", "c_id", "x"), at)
    return spark.read.parquet(at)


@query()
def sink_checkpoint(spark, sf_dir):
    """Model arrays written and read again: names, shapes and sums."""
    p = kernels.text_cnn_init(50, 8, 2, 1, filters=4)
    at = storage.new_path(spark, "model")
    writers.save_checkpoint(spark, p, at)
    back = writers.load_checkpoint(spark, at)
    return spark.createDataFrame([(k, ",".join(map(str, v.shape)), bool((v == p[k]).all())) for k, v in back.items()], "name string, shape string, same boolean")


VOCAB20 = f"WITH t AS ({toks()}) SELECT * FROM ({first_seen(20)})"
CELLS = f"SELECT row_number() OVER (ORDER BY w_id, c_id) - 1 AS row, w_id AS center, c_id AS ctx, x FROM ({ORACLES['cooccurrence']})"


@query(f"SELECT row, a.word AS word, b.word AS context, x FROM ({CELLS}) JOIN ({VOCAB20}) AS a ON a.id = center JOIN ({VOCAB20}) AS b ON b.id = ctx")
def sink_training_cells(spark, sf_dir):
    """Data, labels and vocabulary of co-occurrence cells, written and joined again."""
    at = storage.new_path(spark, "training")
    v, ids = corpora.word_lists(docs(spark, sf_dir), config.POLICIES["glove"])
    writers.write_training_cells(pairs.cooccurrence(ids, 2).select("w_id", "c_id", "x"), v, at)
    words = spark.read.parquet(f"{at}/vocabulary")
    both = spark.read.parquet(f"{at}/data").join(spark.read.parquet(f"{at}/label"), "row")
    named = storage.join_keys(both, words.select(F.col("id").alias("w_id"), "word"), "w_id", "inner")
    return storage.join_keys(named, words.select(F.col("id").alias("c_id"), F.col("word").alias("context")), "c_id", "inner").select("row", "word", "context", "x")


@query(f"""WITH {PARALLEL} SELECT row, 'ref: ' || array_to_string(src, ' ') || chr(10) || 'pred: ' || array_to_string(tgt, ' ') || chr(10) AS value FROM q""")
def sink_report(spark, sf_dir):
    both = corpora.parallel_turns(storage.table(spark, sf_dir, "conversations")).select("row", F.col("src").alias("ref"), F.col("tgt").alias("pred"))
    return writers.report_lines(both, "row")


# Training and inference


def _losses(spark, losses: list[float]) -> DataFrame:
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "round long, loss double")


@query()
def train_skipgram(spark, sf_dir):
    """Losses of three rounds over all occurrences of skip-gram pairs, with three draws of noise each."""
    cfg = config.Word2Vec()
    v, ids = corpora.word_lists(docs(spark, sf_dir), config.POLICIES["word2vec"])
    # pairs and noise are made together, so that no task and no batch learns from one of them alone
    rows, made = pairs.draw_triples(ids, pairs.noise(v), cfg.window, cfg.negatives)
    return _losses(spark, train.skipgram(rows, v.count(), 16, 3, expand=made)[1])


@query()
def train_huffman(spark, sf_dir):
    """Losses of two rounds over the paths of all occurrences of skip-gram pairs."""
    v, ids = corpora.word_lists(docs(spark, sf_dir), config.POLICIES["word2vec_tree"])
    rows, made = pairs.path_triples(ids, storage.materialize(pairs.huffman_paths(v), "paths"), config.Word2Vec().window)
    n = v.count()
    return _losses(spark, train.skipgram(rows, n, 16, 2, nodes=2 * n, expand=made)[1])


@query()
def train_glove(spark, sf_dir):
    v, ids = corpora.word_lists(docs(spark, sf_dir), config.POLICIES["glove"])
    cells = storage.materialize(pairs.cooccurrence(ids, 2).select("w_id", "c_id", "x"), "cells")
    return _losses(spark, train.glove(cells, v.count(), 16, 3)[1])


def _classes(spark, sf_dir) -> DataFrame:
    label = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).when(F.col("lang") == "es", 2).otherwise(3)
    return docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), label.alias("label"))


@query()
def train_ngram_classifier(spark, sf_dir):
    """Accuracy of the averaged n-gram classifier on languages after four rounds."""
    rows = corpora.ngram_rows(docs(spark, sf_dir)).join(_classes(spark, sf_dir), "doc")
    rows = storage.materialize(rows, "ngram-rows")
    size = rows.agg(F.max(F.array_max("ids"))).first()[0] + 1
    params, _ = train.averaged(rows.select("ids", "label"), kernels.bag_init(size, 10, 4, 1), lambda p, ids, label: kernels.bag_step(p, ids.astype(np.int64), label.astype(np.int64), 2.0), 4, 16)
    got = train.infer(rows, params, kernels.bag_forward, ["doc", "label"])
    return metrics.accuracy(got, arrays.argmax(F.col("scores")), F.col("label"))


@query()
def train_word2vec_ml(spark, sf_dir):
    """Vectors from the library's own Word2Vec, learned by as many tasks as there are cores: words and their dimension."""
    from pyspark.ml.feature import Word2Vec

    d = docs(spark, sf_dir)
    # one task is the trainer's default; each task holds a copy of the vectors, so there are no more of them than cores
    model = Word2Vec(vectorSize=16, minCount=5, maxIter=1, numPartitions=max(2, spark.sparkContext.defaultParallelism), seed=1, inputCol="words", outputCol="v").fit(d.select(corpora.words_of(d).alias("words")))
    return model.getVectors().select("word", F.lit(16).alias("dim"))


def _scored(got: DataFrame) -> DataFrame:
    return got.select("doc", F.size("scores").cast("long").alias("n_scores"), arrays.argmax(F.col("scores")).cast("long").alias("best"))


@query()
def infer_text_cnn(spark, sf_dir):
    rows = corpora.encoded(docs(spark, sf_dir), vocab.VocabPolicy("first_seen", 20, None, ("<pad>", "<unk>")), 59)
    size = 2 + rows.agg(F.max(F.array_max("ids"))).first()[0]
    return _scored(train.infer(rows, kernels.text_cnn_init(size, 32, 2, 1, filters=20), kernels.text_cnn, ["doc"]))


@query()
def infer_char_cnn(spark, sf_dir):
    """Six convolutions over one-hot characters, here with 16 features each."""
    n = len(config.ALPHABET)
    spot = F.transform(F.slice(text.chars(F.lower("text")), 1, 1014), lambda c: F.position(c, F.lit(config.ALPHABET)).cast("int"))
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), arrays.pad(spot, 1014).alias("ids"))

    def forward(p, ids):
        return kernels.char_cnn(p, np.eye(n + 1)[ids][:, :, 1:])

    return _scored(train.infer(rows, kernels.char_cnn_init(n, 4, 1, (16,) * 6, hidden=32), forward, ["doc"], size=16))


@query()
def infer_char_word_lm(spark, sf_dir):
    """Perplexity of an untrained language model over every sentence of 10 to 100 words."""
    cfg = config.CharWordLM()
    least = lambda n, *specials: vocab.VocabPolicy("frequency", 1, n, ("<pad>", "<unk>", *specials))
    got = corpora.lm_losses(docs(spark, sf_dir), kernels.char_word_losses, kernels.char_word_init(64, 200, 1, 8, 16, 8, 16), cfg, least(60, "<start>"), least(198))
    own = got.groupBy("doc").agg((F.sum("loss") / F.sum("n")).alias("m"))
    return own.agg(F.avg(F.exp("m")).alias("perplexity"), F.count(F.lit(1)).alias("n_sentences"))


@query()
def infer_han(spark, sf_dir):
    """Hierarchical attention over all lines of a document."""
    cfg = config.HAN()
    lists = storage.materialize(corpora.document_lists(docs(spark, sf_dir), cfg), "lists")
    size = 2 + (lists.agg(F.max(F.array_max(F.flatten("sents")))).first()[0] or 0)
    return _scored(train.infer_documents(lists, kernels.han_init(size, 10, 1, 16, 8), cfg.sentence_length))


LENGTH = config.Translator().length


def _translation(spark, sf_dir) -> tuple[DataFrame, int, int]:
    rows, sv, tv = corpora.translation_rows(corpora.parallel_turns(storage.table(spark, sf_dir, "conversations")), config.Translator())
    return storage.materialize(rows.select(F.col("row").alias("doc"), "tgt", F.concat("src", "tgt_in").alias("ids")), "translation"), sv.count() + 4, tv.count() + 4


@query()
def infer_translator(spark, sf_dir):
    """Greedy output of an untrained four-layer translator: ids up to the end mark."""
    rows, s, t = _translation(spark, sf_dir)
    got = train.infer(rows, kernels.translator_init(s, t, 1, 8, 8), lambda p, ids: kernels.translate_greedy(p, ids[:, :LENGTH], LENGTH), ["doc"])
    return got.select("doc", arrays.text_of(arrays.until_end(F.transform("scores", lambda x: x.cast("int")))).alias("ids"))


@query()
def infer_attention_translator(spark, sf_dir):
    """Masked loss of an untrained attention translator with the target given."""
    rows, s, t = _translation(spark, sf_dir)
    got = train.infer(rows.select("doc", "tgt", F.concat("ids", "tgt").alias("ids")), kernels.attention_init(s, t, 1, 8, 8), lambda p, ids: kernels.attention_losses(p, ids[:, :LENGTH], ids[:, LENGTH : 2 * LENGTH], ids[:, 2 * LENGTH :]), ["doc", "tgt"])
    flat_ = got.select("doc", F.posexplode("scores").alias("p", "loss"), "tgt").select("doc", "loss", (F.element_at("tgt", F.col("p") + 1) != 0).cast("int").alias("w"))
    return metrics.masked_mean_loss(flat_, F.col("loss"), F.col("w"))


# Streams


def _events(spark, sf_dir) -> DataFrame:
    at = f"{sf_dir}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(at).schema).parquet(f"{at}*").withColumn("ts", F.col("ts").cast("timestamp"))


@query()
def stream_ema(spark, sf_dir):
    got = folds.run_once(folds.moving_average(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "value"), "stream-ema")
    return got.groupBy("user_id").agg(F.max_by("ema", "epoch").alias("ema"), F.max("n").alias("n")).select("user_id", F.round("ema", 6).alias("ema"), "n")


@query()
def stream_early_stop(spark, sf_dir):
    got = folds.run_once(folds.early_stop(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "value", 5), "stream-stop")
    return got.groupBy("user_id").agg(F.max_by(F.struct("best", "counter", "stop_at"), "epoch").alias("s")).select("user_id", "s.*")


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    got = folds.run_once(folds.windowed(_events(spark, sf_dir), "ts", ["event_type"], "value"), "stream-windows")
    last = got.groupBy("window", "event_type").agg(F.max_by(F.struct("n", "total"), "epoch").alias("s"))
    return last.select(F.col("window.start").alias("start"), "event_type", "s.n", F.round("s.total", 4).alias("total"))


@query("""WITH w AS (SELECT max(ts) AS m FROM events), r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events, w WHERE ts <= m - INTERVAL 1 HOUR)
SELECT user_id, round(sum(value * pow(0.95::DOUBLE, n - r) * CASE WHEN r = 1 THEN 1 ELSE 0.05::DOUBLE END), 6) AS ema, max(n) AS n FROM r GROUP BY user_id""")
def stream_ordered_ema(spark, sf_dir):
    """Moving averages in event time: all events that the watermark, an hour behind the latest, has passed."""
    step = lambda old, v: v if old is None else 0.95 * old + 0.05 * v
    got, _ = timed.run_counted(timed.ordered_fold(_events(spark, sf_dir), "user_id", "ts", "event_id", "value", step, "1 hour", "1000 days"), "stream-ordered")
    return got.groupBy("user_id").agg(F.max_by("value", "n").alias("ema"), F.max("n").alias("n")).select("user_id", F.round("ema", 6).alias("ema"), "n")


ORACLES["stream_ema"] = ORACLES["ema"]
ORACLES["stream_early_stop"] = ORACLES["early_stop"]


# Named in the reference's topic list


@query(f"""WITH w AS (SELECT doc_id, unnest({WORDS}) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY ALL), d AS (SELECT word, count(*) AS df FROM c GROUP BY word),
s AS (SELECT doc_id, word, round(tf * ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (df + 1)), 6) AS score FROM c JOIN d USING (word))
SELECT doc_id, word, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, word) AS r FROM s) WHERE r <= 5""")
def tfidf_keywords(spark, sf_dir):
    """The five words of each document with the largest TF-IDF."""
    d = docs(spark, sf_dir)
    return ranking.tfidf(d, corpora.words_of(d), 5)


@query()
def lda_topics(spark, sf_dir):
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    d = docs(spark, sf_dir)
    words = d.select("doc_id", corpora.words_of(d, True).alias("words"))
    counts = CountVectorizer(inputCol="words", outputCol="features", vocabSize=2000, minDF=5).fit(words).transform(words)
    return LDA(k=4, maxIter=3, seed=1).fit(counts).describeTopics(8).select("topic", arrays.text_of(F.col("termIndices")).alias("terms"))



@query()
def boosted_trees(spark, sf_dir):
    """Ten trees on the words of the labelled documents, four fifths of which they learn from: log odds of good quality."""
    labels = storage.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    d = docs(spark, sf_dir).select("doc_id", "text").join(F.broadcast(labels) if storage.fits(labels) else labels, "doc_id")
    d = storage.materialize(d.repartition("doc_id"), "labelled")  # read twice: for the features and for the bags
    rows = storage.materialize(boost.bags(d, corpora.words_of(d, True), keep=("label",)), "bags")
    trees = boost.fit(rows.where("doc % 5 <> 0"), 10, 3)
    return boost.scores(rows, trees, ("doc", "label")).select(F.col("doc").alias("doc_id"), "label", (F.col("doc") % 5 == 0).alias("held_out"), F.round("score", 4).alias("score"))
