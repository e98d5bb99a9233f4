"""Operator 5: SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary joins a non-marker to a following white-space marker, and none holds a line feed beside other
characters (both are checked when the model is loaded), so merges never cross these places. A text is cut there; each
distinct chunk is segmented once and its ids are joined back by position. The table of distinct chunks lives in the task
and is emptied when it holds MEMO chunks: the work needs no shuffle, and memory stays bounded whatever the vocabulary.
A model that fails the check is encoded text by text.

Defined results: null and empty texts have no ids and decode to the empty string; texts without any marker are one chunk,
whatever their length; rows repeat as given; extra columns are kept unless an output has their name.
"""

from __future__ import annotations

import hashlib
import re


import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import load, release, with_arrow_columns

MARK = "▁"
MEMO = 200_000
#: Chunks longer than this are not worth a place in the table.
LONG = 200
DIGESTS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkCodec:
    """Encodes texts by distinct chunks; equal to the library's encode() and decode() on whole texts."""

    def __init__(self, path: str, memo: int = MEMO):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.memo_size, self.memo = memo, {}
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.lead = self.model.encode("\n", num_threads=1)
        self.free = (
            not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
            and not any("\n" in p and p != "\n" for p in pieces)
            and self.model.encode("a  b", num_threads=1) == self._by_chunks("a  b")
            and self.model.decode(self.lead) == "\n"
        )

    def _segment(self, chunk: str) -> tuple[list[int], str]:
        """The ids and the decoded text of a chunk of marked text."""
        if chunk == MARK:
            ids = [self.model.piece_to_id(MARK)]
        elif chunk[0] == MARK:
            ids = self.model.encode(chunk[1:], num_threads=1)
        else:
            ids = self.model.encode("\n" + chunk, num_threads=1)[len(self.lead) :]
        return ids, self.model.decode(self.lead + ids)[1:]

    def chunks(self, text: str) -> list[str]:
        marked = (MARK + text).replace(" ", MARK) if text else ""
        return re.findall(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+", marked)

    def _by_chunks(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for i in self._segment(c)[0]]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return self._by_chunks(text) if self.free else self.model.encode(text, num_threads=1)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """How many ids, and the decimal ids joined by commas and the decoded text."""
        if not text:
            return 0, "", ""
        if not self.free:
            ids = self.model.encode(text, num_threads=1)
            return len(ids), ",".join(map(str, ids)), self.model.decode(ids)
        memo, rows = self.memo, []
        for chunk in self.chunks(text):
            row = memo.get(chunk)
            if row is None:
                ids, decoded = self._segment(chunk)
                row = (len(ids), ",".join(map(str, ids)), decoded)
                if len(chunk) <= LONG:
                    if len(memo) >= self.memo_size:
                        memo.clear()
                    memo[chunk] = row
            rows.append(row)
        n, ids, decoded = zip(*rows, strict=True)
        whole = "".join(decoded)
        return sum(n), ",".join(ids), whole[1:] if whole[:1] == " " else whole  # the first marker is the library's own


def encode_documents(docs: DataFrame, text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """docs with the token count and digests of ids and decoded text; with_ids adds the ids (ids array<int>)."""
    path = path or model_path()
    codecs: list[ChunkCodec] = []  # one a task
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        if not codecs:
            release()
            codecs.append(ChunkCodec(path))
        made = [codecs[0].digest(t) for t in batch.column(text_col).to_pylist()]
        out = [pa.array([m[0] for m in made], pa.int64()), pa.array([sha(m[1]) for m in made]), pa.array([sha(m[2]) for m in made])]
        if with_ids:
            out.append(pa.array([[int(i) for i in m[1].split(",")] if m[1] else [] for m in made], pa.list_(pa.int32())))
        return out

    return with_arrow_columns(docs, make, DIGESTS | ({"ids": "array<int>"} if with_ids else {}))


def decode_documents(encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """encoded with decoded, the text of its ids."""
    path = path or model_path()

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [pa.array([model.decode(ids or []) for ids in batch.column(ids_col).to_pylist()], pa.string())]

    return with_arrow_columns(encoded, make, {"decoded": "string"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
