"""Settings of the pipelines."""

from __future__ import annotations

from dataclasses import dataclass

from weftline.operators.vocab import VocabPolicy


@dataclass(frozen=True)
class Word2Vec:
    min_count: int = 3
    tree_min_count: int = 20
    window: int = 3
    batch: int = 32
    negatives: int = 3
    slots: int = 100_000_000


@dataclass(frozen=True)
class Glove:
    dim: int = 300
    rounds: int = 1
    rate: float = 1e-3
    batch: int = 32
    min_count: int = 20
    window: int = 2
    x_max: float = 100.0
    alpha: float = 0.75


@dataclass(frozen=True)
class CharWordLM:
    chars: int = 512
    words: int = 5000
    word_length: int = 16
    sentence_length: int = 100
    char_dim: int = 50
    char_hidden: int = 150
    lm_hidden: int = 150
    word_dim: int = 50
    budgets: tuple[tuple[str, int], ...] = (("train", 1_000_000), ("valid", 20_000), ("test", 20_000))


@dataclass(frozen=True)
class TextCNN:
    dim: int = 300
    widths: tuple[int, ...] = (3, 4, 5)
    filters: int = 100
    l2: float = 0.004
    rate: float = 5e-4
    batch: int = 50
    patience: int = 10
    seed: int = 1


@dataclass(frozen=True)
class CharCNN:
    length: int = 1014
    features: tuple[int, ...] = (256,) * 6
    widths: tuple[int, ...] = (7, 7, 3, 3, 3, 3)
    classes: int = 4


@dataclass(frozen=True)
class NgramClassifier:
    dim: int = 10
    rate: float = 0.02
    batch: int = 64
    length: int = 100
    min_count: int = 3
    n: int = 2
    buckets: int = 100_000
    rounds: int = 1


@dataclass(frozen=True)
class HAN:
    dim: int = 200
    hidden: int = 50
    classes: int = 10
    min_count: int = 5
    sentence_length: int = 100
    batch: int = 64


@dataclass(frozen=True)
class Translator:
    words: int = 29_996
    length: int = 100
    dim: int = 256
    rate: float = 0.02
    batch: int = 64


#: Vocabulary policies by pipeline.
POLICIES = {
    "word2vec": VocabPolicy("first_seen", 3),
    "word2vec_tree": VocabPolicy("first_seen", 20),
    "glove": VocabPolicy("first_seen", 20),
    "text_cnn": VocabPolicy("first_seen", 1, None, ("<pad>",)),
    "ngrams": VocabPolicy("first_seen", 3, None, ("<pad>", "<unk>")),
    "lm_words": VocabPolicy("frequency", 1, 4998, ("<pad>", "<unk>")),
    "lm_chars": VocabPolicy("frequency", 1, 509, ("<pad>", "<unk>", "<start>")),
    "han": VocabPolicy("first_seen", 5, None, ("<pad>", "<unk>")),
    "translator": VocabPolicy("frequency", 1, 29_996, ("<pad>", "<unk>", "<start>", "<end>")),
}
#: 36 characters that stand in for the alphabet file.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
