"""Vocabularies that build columns: code points, white-space words, dictionaries, pass-through and model files."""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.arrays import filled, let

PAD_ID = -1


class Vocabulary(ABC):
    """Ids of a text and back.  ``size`` counts the base ids and the extra ones after them."""

    def __init__(self, base_size: int, bos: int | None = None, eos: int | None = None, unk: int | None = None, extra_ids: int = 0, pad: int = PAD_ID):
        self.base_size, self.bos, self.eos, self.unk, self.pad, self.extra_ids = base_size, bos, eos, unk, pad, extra_ids

    @property
    def size(self) -> int:
        return self.base_size + self.extra_ids

    @abstractmethod
    def encode(self, text: Column) -> Column: ...

    @abstractmethod
    def _decode(self, ids: Column) -> Column: ...

    def _known(self, ids: Column) -> Column:
        return ids if self.unk is None else F.transform(ids, lambda x: F.when(x >= self.base_size, F.lit(self.unk)).otherwise(x))

    def decode(self, ids: Column) -> Column:
        return self._decode(self.until_eos(ids))

    def until_eos(self, ids: Column) -> Column:
        """Unknown ids replaced, and nothing after the first end of sequence."""
        known = self._known(ids)
        if self.eos is None:
            return known
        return let(known, lambda k: let(F.array_position(k, F.lit(self.eos)).cast("int"), lambda at: F.when(at > 0, F.slice(k, F.lit(1), at)).otherwise(k)))

    def padded_after_eos(self, ids: Column) -> Column:
        """The same with padding in place of what would be cut off, so lengths stay."""
        known = self._known(ids)
        if self.eos is None:
            return known
        kept = self.until_eos(ids)
        return F.concat(kept, filled(self.pad, F.size(known) - F.size(kept)))


class PassThroughVocabulary(Vocabulary):
    """Arrays of ids stay what they are."""

    def encode(self, text: Column) -> Column:
        return text

    def _decode(self, ids: Column) -> Column:
        return ids


class CodepointVocabulary(Vocabulary):
    def __init__(self, **kw):
        super().__init__(0x110000, **kw)

    def encode(self, text: Column) -> Column:
        return F.when(F.length(text) > 0, F.transform(F.split(text, ""), lambda c: F.ascii(c))).otherwise(F.array().cast("array<int>"))

    def _decode(self, ids: Column) -> Column:
        return F.array_join(F.transform(ids, lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")), "")


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


class DictionaryVocabulary(Vocabulary):
    """Whole strings as ids: 0 pads, then the given strings in order, then one unknown id.

    Small dictionaries are a map literal; :meth:`join_ids` takes them as a table for rows of strings.
    """

    def __init__(self, unigrams: list[str]):
        super().__init__(len(unigrams) + 2, unk=len(unigrams) + 1, pad=0)
        self.unigrams = unigrams

    def encode(self, text: Column) -> Column:
        known = F.create_map(*[F.lit(v) for i, u in enumerate(self.unigrams) for v in (u, i + 1)])
        return F.coalesce(F.element_at(known, text), F.lit(self.unk))

    def _decode(self, ids: Column) -> Column:
        names = F.array(*map(F.lit, ["", *self.unigrams, "UNK"]))
        return F.array_join(F.transform(ids, lambda i: F.get(names, i)), " ")

    @staticmethod
    def join_ids(strings: DataFrame, dictionary: DataFrame, unk: int) -> DataFrame:
        """``strings`` (with ``word``) and their ``id`` from ``dictionary`` (``word, id``), ``unk`` where there is none."""
        return strings.join(dictionary, "word", "left").withColumn("id", F.coalesce("id", F.lit(unk)))


class ModelVocabulary(Vocabulary):
    """Ids from a tokenizer that a loader opens once in each worker; rows go through it in Arrow batches."""

    def __init__(self, loader: Callable[[], object], base_size: int, **kw):
        super().__init__(base_size, **kw)
        self.loader = loader
        self.key = hashlib.sha256(cloudpickle.dumps(loader)).hexdigest()  # with all that the loader has closed over

    def encode(self, text: Column) -> Column:
        loader, key = self.loader, self.key

        @F.pandas_udf("array<int>")
        def run(batch: pd.Series) -> pd.Series:
            model = _opened(key, loader)
            return pd.Series([list(model.encode(t or "")) for t in batch])

        return run(text)

    def decode(self, ids: Column) -> Column:
        """Unknown ids are replaced and the end of sequence ends the text, in the same pass as the model's decoding."""
        loader, key, base, unk, eos = self.loader, self.key, self.base_size, self.unk, self.eos

        @F.pandas_udf("string")
        def run(batch: pd.Series) -> pd.Series:
            model = _opened(key, loader)
            out = []
            for x in batch:
                known = [int(i) if unk is None or i < base else unk for i in x]
                out.append(model.decode(known[: known.index(eos) + 1] if eos in known else known))
            return pd.Series(out)

        return run(ids)

    def _decode(self, ids: Column) -> Column:
        return self.decode(ids)


_models: dict = {}


def _opened(key: str, loader):
    if key not in _models:
        _models[key] = loader()
    return _models[key]


def sentence_pieces(path: str, extra_ids: int = 0, reverse: bool = False, extra_tokens: tuple[str, ...] = (), start_first: bool = False):
    """A loader of a SentencePiece model file, with pieces of the user's own after its own.

    ``extra_ids`` adds ``<extra_id_0>`` and so on (the highest number first with ``reverse``), ``extra_tokens`` further
    pieces; all take effect at a word's start. ``start_first`` puts begin and end before the unknown piece.
    """
    return partial(_load_pieces, path, extra_ids, reverse, tuple(extra_tokens), start_first)


def shared_file(spark, path: str) -> str:
    """Sends a file to all workers and gives the name under which a loader finds it there (:func:`sentence_pieces` takes it)."""
    spark.sparkContext.addFile(path)
    return f"shared:{path.rsplit('/', 1)[-1]}"


def _load_pieces(path: str, extra_ids: int = 0, reverse: bool = False, extra_tokens: tuple[str, ...] = (), start_first: bool = False):
    import sentencepiece

    if path.startswith("shared:"):
        from pyspark import SparkFiles

        path = SparkFiles.get(path.removeprefix("shared:"))
    if not (extra_ids or extra_tokens or start_first):
        return sentencepiece.SentencePieceProcessor(model_file=path)
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if start_first:
        unknown = sentencepiece_model_pb2.ModelProto.SentencePiece()
        unknown.CopyFrom(model.pieces[0])
        del model.pieces[0]
        model.pieces.insert(2, unknown)
    numbers = range(extra_ids)
    for name in [*(f"<extra_id_{i}>" for i in (reversed(numbers) if reverse else numbers)), *extra_tokens]:
        model.pieces.add(piece=f"\u2581{name}", score=0.0, type=sentencepiece_model_pb2.ModelProto.SentencePiece.USER_DEFINED)
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


class PieceVocabulary(ModelVocabulary):
    """A SentencePiece model; two are equal if their files and extra pieces are."""

    def __init__(self, path: str, extra_ids: int = 0, reverse: bool = False, extra_tokens: tuple[str, ...] = (), start_first: bool = False, pad: int = PAD_ID):
        model = _load_pieces(path, extra_ids, reverse, extra_tokens, start_first)
        size = model.vocab_size()
        super().__init__(sentence_pieces(path, extra_ids, reverse, extra_tokens, start_first), size - extra_ids, bos=model.bos_id(), eos=model.eos_id(), unk=model.unk_id(), extra_ids=extra_ids, pad=pad)
        self.digest = hashlib.md5(model.serialized_model_proto()).hexdigest()
        self.encode_text = model.encode

    def _known(self, ids: Column) -> Column:
        return F.transform(ids, lambda x: F.when(x >= self.size, F.lit(self.unk)).otherwise(x))

    def __eq__(self, other) -> bool:
        return isinstance(other, PieceVocabulary) and (self.digest, self.extra_ids) == (other.digest, other.extra_ids)

    def __hash__(self) -> int:
        return hash((self.digest, self.extra_ids))


#: Families of models, whose special tokens are found after a blank or at once.
FAMILIES = {"llama": "", "mistral": "", "gemma": " "}


def register_family(family: str, path: str, extra_ids: int = 0, extra_tokens: tuple[str, ...] = ()) -> None:
    """Makes ``vocabulary(family)`` open a model file of one of the known families, extra ids in descending order."""
    if family not in FAMILIES:
        raise ValueError(f"no family {family!r}; there are {sorted(FAMILIES)}")
    register_vocabulary(family, partial(PieceVocabulary, path, extra_ids, True, extra_tokens))


def special_ids(vocabulary: PieceVocabulary, tokens: tuple[str, ...], family: str = "llama") -> dict[str, int]:
    """The id of each special token; each must be one piece."""
    ids = vocabulary.encode_text(FAMILIES[family] + " ".join(tokens))
    if len(ids) != len(tokens):
        raise ValueError("a special token isn't one piece")
    return dict(zip(tokens, ids, strict=True))


def with_special(ids: Column, bos: int | None, eos: int | None, second: Column | None = None) -> Column:
    """One sequence, or two one after the other, each between its begin and end marks where they are given."""
    one = lambda x: F.concat(*([F.array(F.lit(bos))] if bos is not None else []), x, *([F.array(F.lit(eos))] if eos is not None else []))
    return one(ids) if second is None else F.concat(one(ids), one(second))


def token_types(ids: Column) -> Column:
    """Zeros, one for each token: the model knows one type."""
    return F.array_repeat(F.lit(0), F.size(ids))


class SpecialDecoder:
    """Decoding that keeps special tokens word by word: what lies between them is decoded by the model, the whole is stripped."""

    def __init__(self, vocabulary: ModelVocabulary, special: dict[str, int]):
        self.vocabulary, self.special = vocabulary, {i: t for t, i in special.items()}

    def decode(self, ids: Column, skip_special: bool = False) -> Column:
        loader, key, special = self.vocabulary.loader, self.vocabulary.key, self.special

        @F.pandas_udf("string")
        def run(batch: pd.Series) -> pd.Series:
            model, out = _opened(key, loader), []
            for x in batch:
                parts, plain = [], []
                for i in map(int, x):
                    if i in special:
                        parts += [model.decode(plain)] * bool(plain) + [special[i]] * (not skip_special)
                        plain = []
                    else:
                        plain.append(i)
                out.append("".join(parts + [model.decode(plain)] * bool(plain)).strip())
            return pd.Series(out)

        return run(ids)


_REGISTRY: dict[str, Callable[[], Vocabulary]] = {"codepoint": CodepointVocabulary, "pass_through": lambda: PassThroughVocabulary(0)}


def register_vocabulary(name: str, make: Callable[[], Vocabulary]) -> None:
    _REGISTRY[name] = make


def vocabulary(name: str) -> Vocabulary:
    if name not in _REGISTRY:
        raise ValueError(f"no vocabulary {name!r}; there are {sorted(_REGISTRY)}")
    return _REGISTRY[name]()


def special_token_mask(n: Column, add_bos: bool, add_eos: bool) -> Column:
    """1 at the added special tokens, 0 at the ``n`` tokens of the text."""
    return F.concat(F.array(*([F.lit(1)] if add_bos else [])).cast("array<int>"), F.array_repeat(F.lit(0), n), F.array(*([F.lit(1)] if add_eos else [])).cast("array<int>"))
