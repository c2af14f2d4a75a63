"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here; its normaliser, metaspace marker, scores and byte fallback are rebuilt as a
tokenizer of the tokenizers library: unigram scores as a Unigram model, a BPE model's scores as merges in their order.
Batches are encoded on several threads.

Where no piece holds the marker behind another character (checked on the vocabulary), no piece reaches over a blank,
so that a text's ids are those of its words end to end; a block then encodes each distinct word once. Texts with
leading, trailing or double blanks, and other models, are encoded whole. Parity with the sentencepiece library is
verified on every distinct word, or on the whole texts where those were encoded whole.

Defined cases: null and empty texts have no ids; equal rows get equal results; very long texts are one row each; other
columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafworks.llm.common import blocks, column, documents, flat_text, named

MARK = "▁"
#: Protobuf's numbers of the piece types and models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return value, i


def fields(b: bytes):
    """(field number, value) of a protobuf message: integers, or bytes."""
    i = 0
    while i < len(b):
        key, i = varint(b, i)
        if key & 7 == 0:
            value, i = varint(b, i)
        else:
            n, i = varint(b, i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class Model:
    """What a model file says."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normaliser = {}, {}
        for number, value in fields(raw):
            if number == 1:
                x = dict(fields(value))
                self.pieces.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap, self.rule = normaliser.get(2, b""), normaliser.get(1, b"")
        self.prefix, self.squeeze, self.escape = (bool(normaliser.get(k, 1)) for k in (3, 4, 5))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), None)
        inner = any(p[2] in (NORMAL, USER) and MARK in p[0].lstrip(MARK) for p in self.pieces)
        self.by_word = not (inner or self.charsmap or self.squeeze) and self.prefix and self.escape and not any(p[2] == USER for p in self.pieces)

    def tokenizer(self):
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

        if self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unknown, byte_fallback=self.byte_fallback)
        elif self.kind == BPE:
            vocabulary = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            whole = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER)}
            merges = sorted(((-s, vocabulary[p[:k]], vocabulary[p[k:]], p[:k], p[k:]) for p, s in whole.items() for k in range(1, len(p)) if p[:k] in whole and p[k:] in whole))
            model = models.BPE(vocabulary, [m[3:] for m in merges], unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"models of type {self.kind} are not supported")
        out = Tokenizer(model)
        # the library maps "\r\n" as one character; the rules of this family turn each into a blank
        steps = [normalizers.Replace("\r\n", "\n\n")] if self.rule.startswith(b"nmt") and self.charsmap else []
        steps += [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        out.normalizer = normalizers.Sequence(steps)
        user = [AddedToken(p, normalized=False) for p, _, kind in self.pieces if kind == USER]
        if user:
            out.add_tokens(user)
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", int(self.prefix), 0)])
        return out

    def piece_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' bytes end to end as decoding gives them, and where each begins; control pieces are empty."""
        made = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind in (CONTROL, UNUSED) else b" \xe2\x81\x87 " if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.pieces]
        return np.frombuffer(b"".join(made), np.uint8), np.concatenate([[0], np.cumsum([len(m) for m in made])])


@lru_cache(maxsize=4)
def loaded(raw: bytes, threads: int):
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    import sentencepiece

    model = Model(raw)
    return model, model.tokenizer(), sentencepiece.SentencePieceProcessor(model_proto=raw)


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... length[0] of them, then those of start[1], and so on."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def encoded(raw: bytes, threads: int, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids end to end, how many each text has, and whether the sentencepiece library gives the same."""
    _, tokenizer, reference = loaded(raw, threads)
    got = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    same = np.fromiter((a == b for a, b in zip(got, reference.encode(texts, num_threads=threads), strict=True)), bool, len(got))
    n = np.fromiter(map(len, got), np.int64, len(got))
    return np.fromiter((i for x in got for i in x), np.int32, int(n.sum())), n, same


def encode_texts(raw: bytes, texts: pa.Array, threads: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids end to end, number for each text, parity for each text)."""
    model, _, _ = loaded(raw, threads)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lens = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    odd = pc.or_(pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")), pc.match_substring(texts, "  ")).to_numpy(zero_copy_only=False)
    whole = odd if model.by_word else lens > 0
    n, same, ids = np.zeros(len(texts), np.int64), np.ones(len(texts), bool), []
    split = np.nonzero(~whole & (lens > 0))[0]
    words = pc.split_pattern(texts.take(pa.array(split)), " ")
    coded = words.flatten().dictionary_encode() if len(split) else pa.array([], pa.large_string()).dictionary_encode()
    at = coded.indices.to_numpy().astype(np.int64)
    unit_ids, unit_n, unit_same = encoded(raw, threads, coded.dictionary.to_pylist())
    unit_start = np.cumsum(unit_n) - unit_n
    per_text = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    whole_rows = np.nonzero(whole)[0]
    whole_ids, whole_n, whole_same = encoded(raw, threads, texts.take(pa.array(whole_rows)).to_pylist())
    first = np.cumsum(per_text) - per_text
    if len(split):
        n[split] = np.add.reduceat(unit_n[at], first)
        same[split] = np.logical_and.reduceat(unit_same[at], first)
    n[whole_rows], same[whole_rows] = whole_n, whole_same
    ids = np.empty(int(n.sum()), np.int32)
    start = np.cumsum(n) - n
    ids[spread(start[split], n[split])] = unit_ids[spread(unit_start[at], unit_n[at])]
    ids[spread(start[whole_rows], whole_n)] = whole_ids
    return ids, n, same


def decode_ids(raw: bytes, ids: np.ndarray, n: np.ndarray, threads: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end, and how many each has; the blank put before a text is taken away again."""
    model, _, _ = loaded(raw, threads)
    table, begin = model.piece_bytes()
    length = np.diff(begin)[ids]
    out = table[spread(begin[:-1][ids], length)]
    ends = np.concatenate([[0], np.cumsum(length)])
    rows = np.concatenate([[0], np.cumsum(n)])
    size = ends[rows[1:]] - ends[rows[:-1]]
    if model.prefix and len(out):
        start = ends[rows[:-1]]
        cut = start[(size > 0) & (out[np.minimum(start, len(out) - 1)] == 32)]
        keep = np.ones(len(out), bool)
        keep[cut] = False
        size = size - np.isin(start, cut) * (size > 0)
        out = out[keep]
    return out, size


def encoder(raw: bytes, threads: int, digest: bool):
    def encode(batches):
        byte_ids = np.array([kind == BYTE for _, _, kind in Model(raw).pieces])
        for t in blocks(batches, 4 << 20):
            ids, n, same = encode_texts(raw, column(t, "text"), threads)
            base = [column(t, "doc_id"), pa.array(n), pa.array(same)]
            if not digest:
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*base, pa.ListArray.from_arrays(offsets, pa.array(ids))], names=["doc_id", "n_ids", "parity", "ids"])
                continue
            text, at = flat_text(column(t, "text"))
            back, size = decode_ids(raw, ids, n, threads)
            ends, wide = np.cumsum(n), ids.astype("<u4")
            full = np.diff(at)
            moved = np.cumsum(size) - size
            ok = [size[k] == full[k] and back[moved[k] : moved[k] + size[k]].tobytes() == text[at[k] : at[k + 1]] for k in range(len(n))]
            sha = [hashlib.sha1(wide[e - k : e].tobytes()).hexdigest() for e, k in zip(ends, n, strict=True)]
            fallback = np.concatenate([[0], np.cumsum(byte_ids[ids])])
            yield pa.RecordBatch.from_arrays([*base, pa.array(sha), pa.array(fallback[ends] - fallback[ends - n]), pa.array(ok, pa.bool_())], names=["doc_id", "n_ids", "parity", "ids_sha1", "n_byte_ids", "round_trip"])

    return encode


def encode(docs: DataFrame, model_path: str, threads: int = 2, digest: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of each text; with digest, their SHA-1 (as little-endian 32-bit numbers) and whether decoding gives the text."""
    with open(model_path, "rb") as f:
        raw = f.read()
    source = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).alias("text"))
    more = "ids_sha1 string, n_byte_ids long, round_trip boolean" if digest else "ids array<int>"
    return source.mapInArrow(encoder(raw, threads, digest), f"doc_id long, n_ids long, parity boolean, {more}")


def decoder(raw: bytes):
    def decode(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            out, size = decode_ids(raw, lists.flatten().to_numpy(zero_copy_only=False), n)
            at = pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, at, pa.py_buffer(out.tobytes())])
            texts = pa.array([x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), texts], names=["doc_id", "text"])

    return decode


def decode(ids: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    with open(model_path, "rb") as f:
        raw = f.read()
    return ids.select("doc_id", "ids").mapInArrow(decoder(raw), "doc_id long, text string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    return encode(documents(spark, sf_dir), model_path, digest=True)


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
ORACLES: dict[str, str] = {}
