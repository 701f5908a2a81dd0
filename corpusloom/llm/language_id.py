"""Language identification by compression with a raw-content dictionary for each language."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import crc_mod, text_slices

#: Bytes of a language's dictionary, of what one document gives to it at most, and the expected number of documents sampled for it.
DICTIONARY_BYTES, PIECE_BYTES, SAMPLE_DOCS = 32 << 10, 1500, 400
#: Texts are compressed in blocks, each with the dictionary at hand, so that it counts as much at the end of a long text.
BLOCK_BYTES = 2048
LEVEL = 7
#: zstandard takes no shorter dictionary.
LEAST_BYTES = 8
RESULT = "lang_pred string, score double, margin double, rejected boolean"


def letters_only(texts: pa.Array) -> pa.Array:
    """Lower-cased words of letters, with single spaces between them; null for null."""
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.string())), r"[^\pL\pM]+", " "), " ")


def fit_dictionaries(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, piece_bytes: int = PIECE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary for each language from a bounded sample of labelled rows (text, lang), the most frequent language first.

    About sample_docs distinct texts of a language are picked by a hash of the text, however often they repeat and whatever the table's size; each gives its first
    piece_bytes, and a dictionary has dictionary_bytes at most, which is all that goes to the driver. Every language with a letter is learned, their number
    being the only other bound; one that has fewer bytes than zstandard takes as a dictionary repeats them.
    Of equally frequent languages the lesser comes first. Rows with a null text or language teach nothing; no rows give no dictionary.
    """
    place = F.shiftrightunsigned(F.xxhash64("text"), 2).alias("place")
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", place)
    counts = known.groupBy("lang").agg(F.count("*").alias("count"), F.approx_count_distinct("place").alias("texts")).orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return {}
    rate = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], int(min(1.0, sample_docs / max(1, r["texts"])) * (1 << 62)))])
    picked = known.where(F.col("place") <= F.try_element_at(rate, F.col("lang")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            pieces = [x.encode()[:piece_bytes] for x in letters_only(part["text"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([part["lang"], part["place"], pa.array(pieces, pa.binary())], names=["lang", "place", "piece"])

    distinct = picked.mapInArrow(cut, "lang string, place long, piece binary").groupBy("lang", "place").agg(F.min("piece").alias("piece"))
    before = F.sum(F.octet_length("piece") + 1).over(Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    rows = distinct.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < dictionary_bytes).collect()
    out = {}
    for lang in [r["lang"] for r in counts]:
        data = b" ".join(bytes(r["piece"]) for r in sorted(rows, key=lambda r: r["place"]) if r["lang"] == lang)[:dictionary_bytes]
        if data:
            out[lang] = b" ".join([data] * -(-LEAST_BYTES // len(data))) if len(data) < LEAST_BYTES else data
    return out


def compressors(dictionaries: dict[str, bytes]) -> list:
    out = []
    for data in dictionaries.values():
        shared = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False).compress)
    return out


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.002) -> DataFrame:
    """docs' other columns and RESULT, from text alone.

    The language whose dictionary compresses the text best (the first of equal ones); margin is how much smaller that is than the second
    best. Rejected: texts without a letter (und, score 0), and those with a margin under min_margin. The score compares
    the languages' sizes, a byte more halving a language's weight.

    Cases: null and empty texts and those without letters (marks alone are none) are und; without dictionaries all are; rows that repeat get
    equal results; an empty table gives an empty result; a column with a name of RESULT gives way to the result.
    """
    names, added = list(dictionaries), [x.split()[0] for x in RESULT.split(", ")]
    rest = [f for f in docs.schema.fields if f.name not in ("text", *added)]
    schema = StructType([*rest, *StructType.fromDDL(RESULT).fields])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = compressors(dictionaries)
        for part in text_slices(batches):
            rows, texts = [], letters_only(part["text"])
            for text, has_letter in zip(texts.to_pylist(), pc.match_substring_regex(texts, r"\pL").to_pylist(), strict=True):
                raw = text.encode() if has_letter else b""
                if not raw or not names:
                    rows.append(("und", 0.0, 0.0, True))
                    continue
                blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
                sizes = [sum(len(p(b)) for b in blocks) for p in packers]
                best = min(range(len(sizes)), key=sizes.__getitem__)
                second = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best])
                margin = (second - sizes[best]) / second
                score = 1.0 / sum(2.0 ** -min(60, s - sizes[best]) for s in sizes)
                rows.append((names[best], score, margin, margin < min_margin))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*(part[f.name] for f in rest), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*(f.name for f in rest), *added]
            )

    return docs.mapInArrow(predict, schema)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fold = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    dictionaries = fit_dictionaries(docs.where(crc_mod("doc_id", 4) != 2))
    return identify(docs.select("doc_id", fold.alias("held_out"), "text"), dictionaries)
