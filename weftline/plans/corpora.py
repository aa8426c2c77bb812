"""From raw corpora to model-ready tables, one function for each pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import storage
from weftline.functions import arrays, text
from weftline.operators import pairs, sentences, splits, vocab
from weftline.plans import config


def words_of(docs: DataFrame, lower: bool = False) -> F.Column:
    return text.split_words(F.lower("text") if lower else F.col("text"))


def chars_of(docs: DataFrame) -> F.Column:
    """The characters of all words, without what is between them; a text without words is one empty character."""
    bare = F.regexp_replace("text", text.SPACE, "")
    return F.when(bare == "", F.array(F.lit(""))).otherwise(text.chars(bare))


def char_vocab(docs: DataFrame, policy: vocab.VocabPolicy) -> DataFrame:
    """word, id, freq of the characters of all words."""
    return vocab.fit_char_vocab(docs, chars_of(docs), policy)


def word_ids(docs: DataFrame, policy: vocab.VocabPolicy, lower: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, doc-pos-word-id with null ids for unknown words)."""
    toks = vocab.tokens(docs, words_of(docs, lower))
    v = storage.materialize(vocab.fit_vocab(toks, policy), "vocab")
    return v, vocab.lookup_ids(toks, v)


def word_lists(docs: DataFrame, policy: vocab.VocabPolicy, lower: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, doc and ids of its words in order, null for unknown words)."""
    words = words_of(docs, lower)
    v = storage.materialize(vocab.fit_list_vocab(docs, words, policy), "vocab")
    return v, vocab.lists_of(docs, words, v)


def skipgram_pairs(docs: DataFrame, cfg: config.Word2Vec = config.Word2Vec()) -> DataFrame:  # noqa: B008  frozen
    """center, ctx, n."""
    _, ids = word_lists(docs, config.POLICIES["word2vec"])
    return pairs.skipgram_counts(ids, cfg.window)


def glove_cells(docs: DataFrame, cfg: config.Glove = config.Glove()) -> DataFrame:  # noqa: B008
    """w_id, c_id, x, weight."""
    _, ids = word_lists(docs, config.POLICIES["glove"])
    return pairs.cooccurrence(ids, cfg.window, cfg.x_max, cfg.alpha)


def encoded(docs: DataFrame, policy: vocab.VocabPolicy, length: int, lower: bool = False) -> DataFrame:
    """doc and ids, padded to length."""
    words = words_of(docs, lower)
    v = storage.materialize(vocab.fit_list_vocab(docs, words, policy), "vocab")
    return vocab.encode(docs, words, v, most=length).select("doc", arrays.pad(F.col("ids"), length).alias("ids"))


def ngram_rows(docs: DataFrame, cfg: config.NgramClassifier = config.NgramClassifier()) -> DataFrame:  # noqa: B008
    """doc and ids of words and hashed n-grams, padded."""
    words = words_of(docs, True)
    v = storage.materialize(vocab.fit_ngram_vocab(docs, words, cfg.n, cfg.min_count), "ngrams")
    return vocab.encode_ngrams(docs, words, v, cfg.n, cfg.buckets, most=cfg.length).select("doc", arrays.pad(F.col("ids"), cfg.length).alias("ids"))


def parallel_turns(conversations: DataFrame, most: int = 100) -> DataFrame:
    """row (in the order of conversations and turns), src, tgt: user turns with the assistant's next one; both non-empty, without metadata, and of at most `most` words."""
    side = lambda role, name, back: conversations.where(F.col("role") == role).select("conv_id", (F.col("turn") - back).alias("turn"), F.col("text").alias(name))
    both = side("user", "src", 0).join(side("assistant", "tgt", 1), ["conv_id", "turn"])
    ok = lambda c: (F.length(c) > 0) & ~F.startswith(F.col(c), F.lit("<"))
    both = both.where(ok("src") & ok("tgt")).withColumns({"src": text.split_words(F.col("src")), "tgt": text.split_words(F.col("tgt"))})
    kept = both.where((F.size("src") <= most) & (F.size("tgt") <= most)).select("conv_id", "turn", "src", "tgt")
    return storage.number_rows(kept, [F.col("conv_id").asc(), F.col("turn").asc()], "row").select("row", "src", "tgt")


def translation_rows(both: DataFrame, cfg: config.Translator = config.Translator()) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: B008
    """(row, src reversed, tgt_in shifted, tgt closed) and the vocabularies of both sides."""
    out, vocabs = None, []
    for side in ("src", "tgt"):
        rows = both.select(F.col("row").alias("doc_id"), F.col(side).alias("w"))
        v = storage.materialize(vocab.fit_vocab(vocab.tokens(rows, F.col("w")), vocab.VocabPolicy("frequency", 1, cfg.words, ("<pad>", "<unk>", "<start>", "<end>"))), f"{side}-vocab")
        vocabs.append(v)
        ids = vocab.encode(rows, F.col("w"), v, most=cfg.length).select(F.col("doc").alias("row"), F.col("ids").alias(side))
        out = ids if out is None else out.join(ids, "row")
    closed = arrays.close_and_pad(F.col("tgt"), cfg.length)
    got = out.select("row", arrays.pad_reversed(F.col("src"), cfg.length).alias("src"), closed.alias("tgt"))
    return got.select("row", "src", arrays.shift_right(F.col("tgt")).alias("tgt_in"), "tgt"), *vocabs


def flat_words(docs: DataFrame) -> F.Column:
    """Words of texts whose line ends are taken as stops."""
    return text.split_words(text.newlines_to_stops(F.col("text")))


def sentence_models(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(abbreviations, starters) of the corpus, written."""
    return _models(docs)[:2]


def _models(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`sentence_models` and the sure and possible ends that they were learned from, so that texts are searched once."""
    words = flat_words(docs)
    types = storage.materialize(sentences.types(docs, words), "types")
    ends = storage.materialize(sentences.ends(docs, words), "ends")
    short = storage.materialize(sentences.abbreviations(docs, words, types=types), "abbreviations")
    return short, storage.materialize(sentences.starters(docs, words, short, types=types, found=ends), "starters"), ends


def lm_sentences(docs: DataFrame, least: int = 10, most: int = 100) -> DataFrame:
    """doc_id, sent and words of sentences of 10 to 100 words; their ends are learned from the documents themselves."""
    short, first, ends = _models(docs)
    got = sentences.sentences(docs, flat_words(docs), short, first, found=ends)
    return got.select(F.col("doc").alias("doc_id"), "sent", "words").where(F.size("words").between(least, most))


def lm_splits(docs: DataFrame, budgets) -> DataFrame:
    """doc_id, sent, words, n, cum and split. Only the lengths of sentences are summed in order; the few that budgets hold get their words by a join."""
    key = F.struct("doc_id", "sent").alias("key")
    sents = storage.materialize(lm_sentences(docs).select(key, "words"), "sentences")
    got = splits.budget_split(sents.select("key", F.size("words").alias("n")), F.col("n"), [F.col("key.doc_id").asc(), F.col("key.sent").asc()], budgets)
    got = storage.materialize(got, "splits")
    both = sents.join(F.broadcast(got), "key") if storage.fits(got) else sents.join(got, "key")
    return both.select("key.*", "words", "n", "cum", "split")


def _lm_input(docs: DataFrame, cfg: config.CharWordLM, chars: vocab.VocabPolicy | None, lower: vocab.VocabPolicy | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sentences (doc_id and sent as one column, words) and the vocabularies of characters and words of whole documents."""
    c = storage.materialize(char_vocab(docs, chars or config.POLICIES["lm_chars"]), "chars")
    w = storage.materialize(vocab.fit_list_vocab(docs, words_of(docs, True), lower or config.POLICIES["lm_words"]), "words")
    sents = storage.materialize(lm_sentences(docs, most=cfg.sentence_length).select(F.struct("doc_id", "sent").alias("doc_id"), "words"), "sentences")
    return sents, c, w


def lm_places(docs: DataFrame, cfg: config.CharWordLM = config.CharWordLM(), chars: vocab.VocabPolicy | None = None, lower: vocab.VocabPolicy | None = None) -> DataFrame:  # noqa: B008
    """doc_id, sent and places: `vocab.char_places` of every sentence, with vocabularies of whole documents."""
    sents, c, w = _lm_input(docs, cfg, chars, lower)
    return vocab.char_places(sents, F.col("words"), c, w, cfg.sentence_length, cfg.word_length).select("doc.*", "places")


def lm_losses(docs: DataFrame, losses, params: dict, cfg: config.CharWordLM, chars: vocab.VocabPolicy, lower: vocab.VocabPolicy) -> DataFrame:
    """doc (doc_id and sent), loss and n of every sentence: `vocab.sentence_losses` over what `lm_places` has."""
    sents, c, w = _lm_input(docs, cfg, chars, lower)
    return vocab.sentence_losses(sents, F.col("words"), c, w, cfg.sentence_length, cfg.word_length, losses, params)


def lm_rows(docs: DataFrame, cfg: config.CharWordLM = config.CharWordLM(), chars: vocab.VocabPolicy | None = None, lower: vocab.VocabPolicy | None = None, joined: bool = False) -> DataFrame:  # noqa: B008
    """doc_id, sent, pos, word_id, chars and weight: `lm_places` with a row for each place; `joined` has the characters as one text with commas."""
    sents, c, w = _lm_input(docs, cfg, chars, lower)
    return vocab.char_rows(sents, F.col("words"), c, w, cfg.sentence_length, cfg.word_length, joined=joined).select("doc.*", "pos", "word_id", "chars", "weight")


def document_lists(docs: DataFrame, cfg: config.HAN = config.HAN()) -> DataFrame:  # noqa: B008
    """doc, row, batch, sents, most: documents longest first in batches, the ids of each line's first words, not yet padded, and the most lines of a document of the batch.

    The vocabulary is counted over whole documents in the sorted order.
    """
    sized = splits.batches(docs.select("doc_id", "text", F.size(words_of(docs)).alias("n")), [F.col("n").desc(), F.col("doc_id").asc()], cfg.batch)
    toks = vocab.tokens(sized, words_of(sized), "row")
    v = storage.materialize(vocab.fit_vocab(toks, config.POLICIES["han"]), "vocab")
    split = text.split_on(F.col("text"), "\n")
    lines = sized.where("text IS NOT NULL").select(F.struct("row", "doc_id", "batch").alias("own"), F.posexplode(split).alias("sent", "s"))
    keyed = lines.select(F.struct("own", "sent").alias("doc_id"), text.split_words(F.col("s")).alias("w"))
    ids = vocab.encode(keyed, F.col("w"), v, most=cfg.sentence_length).select("doc.own", "doc.sent", "ids")
    own = ids.groupBy("own").agg(F.transform(F.array_sort(F.collect_list(F.struct("sent", "ids"))), lambda x: x["ids"]).alias("sents"))
    most = sized.where("text IS NOT NULL").groupBy("batch").agg(F.max(F.size(split)).alias("most"))
    got = storage.join_keys(own.select(F.col("own.doc_id").alias("doc"), "own.row", "own.batch", "sents"), most, "batch", "inner", salt=F.xxhash64("row"))
    return got.select("doc", "row", "batch", "sents", "most")


def padded_lists(lists: DataFrame, cfg: config.HAN = config.HAN()) -> DataFrame:  # noqa: B008
    """`document_lists` with each sentence padded to a length and each document to its batch's most sentences."""
    empty = F.array_repeat(F.lit(0), cfg.sentence_length)
    sents = F.transform("sents", lambda x: arrays.pad(x, cfg.sentence_length))
    return lists.select("doc", "row", "batch", F.concat(sents, F.array_repeat(empty, F.col("most") - F.size("sents"))).alias("sents"))


def document_matrices(docs: DataFrame, cfg: config.HAN = config.HAN()) -> DataFrame:  # noqa: B008
    """doc, row, batch, sents: documents longest first in batches, each sentence padded to a length and each document to its batch's most sentences.

    Lines stand for sentences. Padding is put on last, so it is neither shuffled nor written.
    """
    return padded_lists(document_lists(docs, cfg), cfg)
