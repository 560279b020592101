"""Language identification by compression.

Each language has a zstandard raw-content dictionary of its own documents. A text goes to the
language under whose dictionary it becomes smallest; a narrow margin is flagged. One rule holds
for texts of every size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.common import small_batches

OTHER = re.compile(r"[\W\d_]+")
UNKNOWN = "und"
#: The sample a dictionary is made of: whole documents a language, by hash of their id, as many as fit
#: in the bytes of a language (the first always fits). All dictionaries together stay within TOTAL_BYTES.
SAMPLE_DOCS, DICTIONARY_BYTES, TOTAL_BYTES = 200, 128 << 10, 32 << 20
#: Relative margin under which a prediction is flagged as rejected.
MARGIN = 0.01
#: Compression level, for learnt and judged texts alike.
LEVEL = 12


def held_out(key: Column, modulus: int = 3, rest: int = 1) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % modulus == rest, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary content by language, from documents that are not held out.

    A bounded sample of whole documents: at most ``SAMPLE_DOCS`` a language by hash of their id,
    and of these as many as fit in ``DICTIONARY_BYTES``, less where the languages are so many that
    ``TOTAL_BYTES`` would be passed; a first document beyond that is taken whole. Ids are ranked
    without their texts. Null id, lang or text and texts without a letter aren't learned from;
    repeated ids add each of their texts.
    """
    key, text = F.col(id_col), F.col(text_col)
    size = F.octet_length(text)
    known = docs.where(key.isNotNull() & F.col(lang_col).isNotNull() & (size > 0) & ~held_out(key)).select(key.alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(key).alias("h"), size.alias("size"))
    order = Window.partitionBy("lang").orderBy("h", "id", "size")
    ranked = known.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE_DOCS)
    room = min(DICTIONARY_BYTES, TOTAL_BYTES // max(1, known.agg(F.count_distinct("lang")).first()[0]))
    chosen = ranked.withColumn("sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("sum") <= room) | (F.col("r") == 1)).select("id", "lang").distinct()
    rows = docs.select(key.alias("id"), F.col(lang_col).alias("lang"), text.alias("text")).join(F.broadcast(chosen), ["id", "lang"]).where("text is not null")  # at most SAMPLE_DOCS ids a language
    content: dict[str, list] = {}
    for _, lang, part in sorted(map(tuple, rows.collect()), key=lambda r: (r[1], r[0], r[2])):
        content.setdefault(lang, []).append(part)
    return {lang: data for lang, parts in content.items() if (data := letters(" ".join(parts)).encode("utf-8", "replace")).strip()}


def letters(text: str) -> str:
    """Lower-cased words between single blanks: case, digits and signs don't tell languages apart."""
    return OTHER.sub(" ", text.lower())


class Classifier:
    def __init__(self, content: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(content)
        self.compressors = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False))

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected): the score is the best size's share under 2^-bytes."""
        data = letters(text or "").encode("utf-8", "replace")
        if not data.strip() or not self.langs:
            return UNKNOWN, 0.0, True
        sizes = [len(c.compress(data)) for c in self.compressors]
        best = min(sizes)
        others = sorted(sizes)[1:]
        margin = (others[0] - best) / others[0] if others else 1.0
        return self.langs[sizes.index(best)], 1 / sum(2.0 ** -min(s - best, 60) for s in sizes), margin < MARGIN


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every document, whole texts, in one narrow pass.

    ``und`` for null text, text without a letter, or when no language could be learned; equal
    sizes go to the first language by name; repeated rows predict alike; other columns are ignored;
    an empty table gives no rows. A very long text is held whole by its task, and compressed in one piece.
    """
    small_batches(docs.sparkSession)
    content = learn(docs, id_col, text_col, lang_col)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(content)
        for texts in batches:
            yield pd.DataFrame([classifier.classify(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    guess = F.pandas_udf(run, "lang_pred string, score double, rejected boolean")
    rows = docs.select(F.col(id_col).alias("doc_id"), guess(F.col(text_col)).alias("g"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "g.lang_pred", "g.score", "g.rejected")
