"""Operator 2: SentencePiece encoding and decoding over a table of distinct chunks.

No piece of the model has a white-space marker after another character, so a text falls into chunks (a run of markers
and what follows it up to the next marker) that no piece crosses. Each distinct chunk is segmented once by the library
for as long as its worker's table holds it, and a text's ids are its chunks' ids joined by position. The table is
emptied when it has TABLE_CHARS characters and at the end of a task, so memory is bounded on any input and a worker that
goes on with other work holds none.

The premise is checked on loading: a model with pieces that cross markers, a normaliser that rewrites text, or no dummy
prefix makes encode() and decode() call the library on whole texts instead.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandline.llm.common import plus, table, tune

#: Characters of chunks that one worker's table holds before it starts anew.
TABLE_CHARS = 2_000_000
_MARK = "▁"
_CHUNK = re.compile(" +[^ ]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkCodec:
    """Encodes and decodes as the sentencepiece library does, with a table of distinct chunks."""

    def __init__(self, model: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        proto = pb.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kind = proto.normalizer_spec, pb.ModelProto.SentencePiece
        plain = norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces and not norm.precompiled_charsmap and not proto.denormalizer_spec.precompiled_charsmap
        own = all(p.type in (kind.NORMAL, kind.UNKNOWN, kind.CONTROL, kind.BYTE) for p in proto.pieces)
        inner = any(_MARK in p.piece.lstrip(_MARK) for p in proto.pieces if p.type == kind.NORMAL)
        self.chunked = bool(plain and own and not inner and not proto.trainer_spec.treat_whitespace_as_suffix and proto.trainer_spec.byte_fallback and self.library.piece_to_id(_MARK) != self.library.unk_id())
        #: each id as text
        self.number = [str(i) for i in range(len(proto.pieces))]
        #: ids of each distinct chunk as text
        self.table: dict[str, str] = {}
        self.held = 0

    def chunks(self, text: str) -> list[str]:
        """The text with its dummy prefix, cut before each run of markers; a blank and the marker are the same here."""
        return _CHUNK.findall(" " + text.replace(_MARK, " "))

    def look_up(self, cut: list[list[str]]) -> dict[str, str]:
        """The table, with every chunk of these texts in it; the other chunks go first if it has become too large."""
        known = self.table
        if self.held > TABLE_CHARS:
            wanted = {c for cs in cut for c in cs}
            known = self.table = {c: e for c, e in known.items() if c in wanted}
            self.held = sum(map(len, known))
        # a marker alone: behind the library's own one there is nothing left to encode
        known.setdefault(" ", self.number[self.library.piece_to_id(_MARK)])
        new = list({c for cs in cut for c in cs if c not in known})
        # the library adds one marker before a text, which is the chunk's own first
        number = self.number
        for c, i in zip(new, self.library.encode([c[1:] for c in new], num_threads=1) if new else (), strict=True):
            known[c] = ",".join([number[k] for k in i])
            self.held += len(c)
        return known

    def forget(self) -> None:
        self.table, self.held = {}, 0

    def written(self, texts: list[str]) -> Iterable[str]:
        """The ids of each text, joined by commas; one text's at a time, so that they don't pile up."""
        if not self.chunked:
            for t in texts:
                yield ",".join(map(str, self.library.encode(t, num_threads=1) if t else []))
            return
        cut = [self.chunks(t) if t else [] for t in texts]
        known = self.look_up(cut)
        for cs in cut:
            yield ",".join([known[c] for c in cs])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [list(map(int, w.split(","))) if w else [] for w in self.written(texts)]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)

    def digests(self, texts: list[str]) -> Iterable[tuple[int, str, str, np.ndarray]]:
        """(number of ids, SHA-256 of the ids as text, SHA-256 of decode(ids), ids) of each text. Only the text at hand has
        its ids as Python numbers, which take nine times the room."""
        sha = hashlib.sha256
        for w in self.written(texts):
            ids = list(map(int, w.split(","))) if w else []
            yield len(ids), sha(w.encode()).hexdigest(), sha(self.decode(ids).encode()).hexdigest(), np.array(ids, np.int32)


_MODELS: dict[str, ChunkCodec] = {}


def codec(model: str) -> ChunkCodec:
    """One codec for each worker and model."""
    if model not in _MODELS:
        _MODELS[model] = ChunkCodec(model)
    return _MODELS[model]


def _groups(texts: list[str], chars: int = 1 << 20) -> Iterable[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield at, i
            at, size = i, 0
        size += len(t)
    if texts:
        yield at, len(texts)


def _clear(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def encode(df: DataFrame, text: str = "text", model: str | None = None, ids: str = "ids") -> DataFrame:
    """df with a column of token ids (array<int>) of each text. Null and empty texts have no ids; a column of that
    name is replaced; rows, ties and repeated rows stay as they are."""
    model = model or default_model()
    df = _clear(df, ids)

    def run(batches):
        c = codec(model)
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            got = [x for i, j in _groups(texts) for x in c.encode(texts[i:j])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.int32()))], [*b.schema.names, ids])
        c.forget()

    return df.mapInArrow(run, plus(df.schema, f"{ids} array<int>"))


def decode(df: DataFrame, ids: str = "ids", model: str | None = None, text: str = "decoded") -> DataFrame:
    """df with the text of each row's ids; null ids give an empty text."""
    model = model or default_model()
    df = _clear(df, text)

    def run(batches):
        c = codec(model)
        for b in batches:
            got = [c.decode(i or []) for i in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], [*b.schema.names, text])

    return df.mapInArrow(run, plus(df.schema, f"{text} string"))


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, with_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row, repeated rows included, and its ids if asked for; a null
    text counts as empty."""
    model = model or default_model()
    df = df.select(key, text)

    def run(batches):
        c = codec(model)
        for b in batches:
            # also what earlier work of a reused worker left in Arrow's pool
            pa.default_memory_pool().release_unused()
            texts = [t or "" for t in b.column(1).to_pylist()]
            # a batch for each group of texts: what is held does not grow with the rows of a batch that comes in
            for i, j in _groups(texts):
                n, a, d, ids = zip(*c.digests(texts[i:j]), strict=True)
                more = [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), *more], [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"][: len(more)]])
        c.forget()

    return df.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{', ids array<int>' if with_ids else ''}")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return round_trip(table(spark, sf_dir, "documents"))
