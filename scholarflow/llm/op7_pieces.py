"""SentencePiece encoding and decoding with a distinct-chunk table.

When no piece has a white-space marker after another character, no merge can cross from a word into
the next marker, so the text falls into independent chunks: a run of markers and the characters up to
the next one. Each task keeps a table of the distinct chunks it has met, segments each of them once
with the library, and joins the ids back by position. The table is bounded; a chunk longer than
`LONG` characters is segmented where it stands and not kept.

A model whose pieces can cross markers, or that rewrites the text before segmenting, is used on whole
texts instead; the result is the same, only slower.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import table, with_columns_from

MARK = "▁"
#: Chunks kept by a task, and the longest that is kept.
TABLE, LONG = 100_000, 64
#: Characters of text that a task segments at a time.
GROUP = 1_000_000
DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


class Chunked:
    """A SentencePiece model that segments each distinct chunk once."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.sp.serialized_model_proto())
        rules, pieces = proto.normalizer_spec, proto.pieces
        self.end = self.sp.eos_id()
        self.dummy = rules.add_dummy_prefix
        self.whole = bool(
            rules.precompiled_charsmap
            or rules.remove_extra_whitespaces
            or not rules.escape_whitespaces
            or proto.trainer_spec.treat_whitespace_as_suffix
            or any(p.type == 4 for p in pieces)
            or any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in pieces if p.type == 1)
        )
        self.chunk = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        # a letter before a chunk keeps decode() from taking the chunk's first marker for the dummy prefix
        self.lead = self.sp.piece_to_id("a")
        self.kept: dict[str, tuple[int, str, str]] = {}

    def segment(self, chunks: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, their decimal form, and the decoded text of each of some chunks in mid-text."""
        # encode() adds the dummy prefix: give it the text without its first marker
        bare = [c[1:] if self.dummy and len(c) > 1 and c[0] == MARK else c for c in chunks]
        ids = self.sp.encode(bare, num_threads=1)
        if self.dummy:
            ids = [[self.sp.piece_to_id(MARK)] if c == MARK else x for c, x in zip(chunks, ids, strict=True)]
        decoded = self.sp.decode([[self.lead, *x] for x in ids], num_threads=1)
        return [(len(x), " ".join(map(str, x)), d[1:]) for x, d in zip(ids, decoded, strict=True)]

    def parts(self, texts: list[str]) -> Iterator[tuple[tuple[int, ...], tuple[str, ...], tuple[str, ...]]]:
        """For each text: its chunks' token counts, decimal ids and decoded texts."""
        kept, prefix = self.kept, MARK if self.dummy else ""
        found = [self.chunk.findall(prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        distinct = set().union(*found)
        if len(kept) + len(distinct) > TABLE:
            kept.clear()
        new = [c for c in distinct if c not in kept]
        kept.update(zip(new, self.segment(new), strict=True))
        for chunks in found:
            yield tuple(zip(*[kept[c] for c in chunks], strict=True)) or ((), (), ())
        for c in new:
            if len(c) > LONG or len(kept) > TABLE:
                del kept[c]

    def each(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, ids in decimal, and decoded text of each text."""
        group, size = [], 0
        for text in [*texts, None]:
            text = text or ""
            group.append(text)
            size += len(text)
            if size > GROUP:
                yield from self._each(group)
                group, size = [], 0
        yield from itertools.islice(self._each(group), len(group) - 1)

    def _each(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        if self.whole:
            ids = self.sp.encode(texts, add_eos=True, num_threads=1)
            yield from ((len(x), " ".join(map(str, x)), self.sp.decode(x)) for x in ids)
            return
        for n, ids, decoded in self.parts(texts):
            out = "".join(decoded)
            yield sum(n) + 1, " ".join((*ids, str(self.end))), out[1:] if self.dummy and out.startswith(" ") else out


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()


def encode_documents(docs: DataFrame, model_file: str, text: str = "text", digests: bool = False) -> DataFrame:
    """`docs` with a struct `_out`: (ids, decoded), or (n_tokens, ids_sha256, decoded_sha256) if `digests`.

    A null text counts as empty: its only id is the end id, and it decodes to the empty string.
    """

    def make():
        coder = Chunked(model_file)
        if digests:
            return lambda texts: [(n, _sha(ids), _sha(decoded)) for n, ids, decoded in coder.each(texts)]
        return lambda texts: [(np.fromstring(ids, np.int32, sep=" "), decoded) for _, ids, decoded in coder.each(texts)]

    return with_columns_from(docs, text, DIGEST if digests else IDS, make)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_pieces(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, model_path(), digests=True).select("doc_id", "_out.*")
