"""Language identification with language-bitmask n-gram filters.

One Bloom filter per language, stored bit-sliced: slot i holds bit l of every language's filter, so
looking up an n-gram in all languages is a few array reads and an AND. A text's score for a
language is the number of its n-grams in that filter, less what the filter's false-positive
rate lets one expect; the largest decides.

The filters are learned from a bounded sample of labelled documents. An n-gram enters the filter of each
language in which its rate is at least ``ratio`` of its highest rate, so that stray mislabelled
documents don't put one language's n-grams into another's filter.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N = 4  # bytes of an n-gram
UNDETERMINED = "und"
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
#: ASCII other than letters becomes a space; bytes of other characters stay.
_CLEAN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _codes(text: str):
    """The text's n-grams as numbers: lower case, words between single spaces."""
    import numpy as np

    b = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(_CLEAN).split()) + b" ", np.uint8).astype(np.uint32)
    if len(b) < N:
        return np.zeros(0, np.uint32)
    return b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)


@dataclass
class BitmaskFilter:
    languages: list[str]
    slots: object  # (words of 64 languages, slots)
    bits: int
    rates: object  # false-positive rate of each language

    @classmethod
    def build(cls, languages: list[str], codes, masks, bits_per_gram: int = 16) -> BitmaskFilter:
        """codes: distinct n-grams; masks: a boolean row of languages for each."""
        import numpy as np

        bits = max(10, int(bits_per_gram * max(len(codes), 1) - 1).bit_length())
        n_words = max(1, -(-len(languages) // 64))
        slots = np.zeros((n_words, 1 << bits), np.uint64)
        for lang in range(len(languages)):
            own = codes[masks[:, lang]]
            for at in cls._places(own, bits):
                slots[lang // 64, at] |= np.uint64(1 << lang % 64)
        fill = np.array([(slots[i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(languages))])
        if len(languages) <= 8:
            slots = slots.astype(np.uint8)
        return cls(list(languages), slots, bits, fill ** len(_MULTIPLIERS))

    @staticmethod
    def _places(codes, bits: int):
        import numpy as np

        for m in _MULTIPLIERS:
            yield ((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(m) >> np.uint64(64 - bits)).astype(np.int64)

    def coverage(self, texts: list[str]):
        """For each text and language: the share of its n-grams in the language's filter, false positives deducted."""
        import numpy as np

        out = np.zeros((len(texts), len(self.languages)))
        at = 0
        while at < len(texts):  # blocks of about 2 MB
            parts, size, first = [], 0, at
            while at < len(texts) and size < 2_000_000:
                parts.append(_codes(texts[at]))
                size += len(parts[-1])
                at += 1
            lengths = np.array([len(p) for p in parts])
            full = np.flatnonzero(lengths)
            if not len(full):
                continue
            codes = np.concatenate(parts)
            starts = (np.cumsum(lengths) - lengths)[full]
            masks = self.slots[:, next(iter(self._places(codes, self.bits)))]
            for k, place in enumerate(self._places(codes, self.bits)):
                if k:
                    masks &= self.slots[:, place]
            for i in range(len(self.languages)):
                word = masks[i // 64]
                hits = np.add.reduceat((word >> word.dtype.type(i % 64) & word.dtype.type(1)).astype(np.int64), starts)
                n, rate = lengths[full], self.rates[i]
                out[first + full, i] = np.clip((hits - n * rate) / (1 - rate + 1e-12), 0, None) / n
        return np.clip(out, 0, 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        import numpy as np

        known = [has_letter(t) for t in texts]
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        cover = self.coverage([t if k else "" for t, k in zip(texts, known)])
        best = cover.argmax(axis=1)
        top = cover[np.arange(len(texts)), best]
        return [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known)], [float(s) if k else 0.0 for s, k in zip(top, known)]


def fit_languages(labelled: DataFrame, docs_per_lang: int = 1500, ratio: float = 0.25, least: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> BitmaskFilter:
    """Learn from about ``docs_per_lang`` labelled documents of each language (all of a rarer one), chosen by hash, so that rare languages are learned too.

    Languages stand in order of their documents, the most first, then by name: ties are decided so.
    """
    sample = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}  # a row per language
    if sizes:
        limits = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1 << 31, (docs_per_lang << 31) // n))))
        sample = sample.where(F.pmod(F.xxhash64("i", "text"), F.lit(1 << 31)) < limits[F.col("lang")])
    sample = sample.dropDuplicates(["i", "lang", "text"])  # repeated rows count once

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            by: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(_codes(text))
            for lang, parts in by.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    made = counts.where(F.col("n") >= least).toPandas()  # distinct n-grams of the sample
    counts.unpersist()
    languages = sorted(totals, key=lambda x: (-sizes.get(x, 0), x))
    import numpy as np

    if not languages:
        return BitmaskFilter.build([], np.zeros(0, np.uint32), np.zeros((0, 0), bool))
    table = made.pivot_table(index="code", columns="lang", values="n", fill_value=0).reindex(columns=languages, fill_value=0).sort_index()
    n = table.to_numpy(float)
    rate = n / np.array([max(totals[x], 1) for x in languages], float)
    return BitmaskFilter.build(languages, table.index.to_numpy().astype("uint32"), (n >= least) & (rate >= ratio * rate.max(axis=1, keepdims=True)))


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame, model: BitmaskFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (coverage by the predicted language's filter, 0 to 1) for every row.

    Null texts and texts without a letter give 'und' and score 0; so does everything where nothing could be learned. Of languages
    with equal coverage, none included, the model's first counts: the one learned from the most documents, then by name. Whole
    texts are read, long ones in blocks. Repeated rows get a row each, other columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            langs, scores = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def predict_column(model: BitmaskFilter, text_col: str) -> F.Column:
    """struct<lang, score> of the text, to be used beside other columns."""

    @F.pandas_udf("lang string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        langs, scores = model.predict(texts.tolist())
        return pd.DataFrame({"lang": pd.Series(langs, dtype=object), "score": pd.Series(scores, dtype=float)})

    return predicted(F.col(text_col))
