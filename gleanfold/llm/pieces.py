"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

A text is cut into marked words (its spaces become the mark, which begins a word; no piece holds a mark after
another character, so no piece spans two words). A batch's distinct words are sorted, which
lays them out as a trie in depth-first order: forward states of the prefix that a word shares with the one before it
are kept, and only the rest is computed.

The model is a BPE model, whose result isn't the path of the highest total score. So the lattice's transitions have
weights: 0 if piece b may follow piece a, which is so if merging a + b by the model's scores gives (a, b), else minus infinity.
The Viterbi recursion takes the best sum of piece scores and transition weights over the paths to each prefix. Exactly one path is
finite for each prefix, and it is the model's own segmentation; a forward state is that path's score and last piece. So the
search for a prefix's best transition ends at the first finite one. Characters without a piece become byte pieces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """Pieces, scores and byte pieces of a model file, and the segmentation of words."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.bytes: list[bytes] = []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                self.ids[piece], self.scores[piece] = i, sp.get_score(i)
                self.bytes.append(piece.replace(MARK, " ").encode())
        self.longest = max(map(len, self.ids), default=1)
        #: white space that is in no piece parts words as well
        self.breaks = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
        self._words = re.compile(f"{MARK}*[^{MARK}{self.breaks}]+|[{self.breaks}]|{MARK}+" if self.breaks else f"{MARK}*[^{MARK}]+|{MARK}+")
        self._may: dict[tuple[str, str], bool] = {}
        self._cache: dict[str, bytes] = {"": b""}
        self._four = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}

    def _as_bytes(self, character: str) -> bytes:
        """A character without a piece, as byte pieces."""
        return b"".join([self.byte_ids[b].to_bytes(4, "little") for b in character.encode()])

    def words(self, text: str) -> list[str]:
        """The text's marked words in order; empty strings may stand between them."""
        if not text:
            return []
        if "  " in text or text[0] == " " or MARK in text or "\n" not in self.breaks:
            return self._words.findall(MARK + text.replace(" ", MARK))
        return (MARK + text).replace(" ", " " + MARK).replace("\n", " \n ").split(" ")  # single spaces: the same words, faster

    def merged(self, text: str) -> list[str]:
        """Pieces of a short string by merging the best-scored neighbours, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, a: str, b: str) -> bool:
        """Whether the segmentation of a + b is (a, b); with an empty a, whether b's is b."""
        key = a, b
        known = self._may.get(key)
        if known is None:
            if len(self._may) > 1_000_000:
                self._may.clear()
            known = self._may[key] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def segment_sorted(self, words: list[str]):
        """Yield (word, pieces) for distinct words in ascending order."""
        last, forward = [""], [0.0]  # forward[i], last[i]: score and last piece of the best path over the first i characters
        scores = self.scores
        before = ""
        ids, may, known, longest = self.ids, self.may_follow, self._may, self.longest
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], forward[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                for j in range(max(0, i - longest), i):
                    piece = word[j:i]
                    if piece in ids or j == i - 1:
                        ok = known.get((last[j], piece))
                        if may(last[j], piece) if ok is None else ok:
                            last.append(piece)
                            forward.append(forward[j] + scores.get(piece, 0.0))
                            break
            before = word
            out, i = [], len(word)
            while i:
                out.append(last[i])
                i -= len(last[i])
            yield word, out[::-1]

    def encode_batch(self, texts: list[str | None], cap: int = 1_000_000) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        cut = [self.words(t or "") for t in texts]
        if len(self._cache) > cap:
            self._cache = {"": b""}
        cache, four = self._cache, self._four
        new = sorted(set().union(*cut) - cache.keys())
        for word, pieces in self.segment_sorted(new):
            cache[word] = b"".join([four.get(p) or self._as_bytes(p) for p in pieces])
        return [b"".join(map(cache.__getitem__, ws)) for ws in cut]

    def decode(self, ids) -> str:
        table = self.bytes
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_models: dict[str, PieceModel] = {}


def model_of(path: str) -> PieceModel:
    """This process's model: a Python worker keeps its words from task to task."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _blocks(texts, size: int = 1_000_000):
    """Lists of texts with about ``size`` characters each."""
    block, held = [], 0
    for t in texts:
        t = t.as_py()
        block.append(t)
        held += len(t or "")
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, with_ids: bool = True, verify: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids) for every row; ids on demand.

    ``verify`` decodes the ids again in the same task and adds decoded_crc32 and round_trip (whether the text came back).
    Null and empty texts have no ids. Repeated rows get a row each; an empty table gives none. Other columns are ignored, whatever their
    names. Very long texts are encoded whole, in a block of their own.
    """
    path = model or default_model()
    fields = ["doc_id long", "n_tokens long", "ids_crc32 long", *["ids array<int>"] * with_ids, *["decoded_crc32 long", "round_trip boolean"] * verify]

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        m = model_of(path)
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(1)):
                made = m.encode_batch(block)
                cols = [batch.column(0).slice(at, len(block)), pa.array([len(x) // 4 for x in made], pa.int64()), pa.array([zlib.crc32(x) for x in made], pa.int64())]
                if with_ids:
                    ends = np.cumsum([0, *(len(x) // 4 for x in made)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(made), "<u4").astype(np.int32))))
                if verify:
                    texts = [m.decode(np.frombuffer(x, "<u4").tolist()) for x in made]
                    cols += [pa.array([zlib.crc32(t.encode()) for t in texts], pa.int64()), pa.array([t == (given or "") for t, given in zip(texts, block)])]
                yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in fields])
                at += len(block)

    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInArrow(run, ", ".join(fields))


def decode_pieces(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """encoded with a column ``decoded``: the text of each row's ids. Other columns stay."""
    path = model or default_model()

    @F.pandas_udf("string")
    def decoded(ids):
        m = model_of(path)
        return ids.map(lambda x: None if x is None else m.decode(x))

    return encoded.withColumn("decoded", decoded("ids"))
