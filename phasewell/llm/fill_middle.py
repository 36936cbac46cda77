"""Operator 13, fill-in-middle transformation: a Split pre-tokenizer of the tokenizers library cuts the text.

``Split(pattern, "isolated")`` needs no training. What it returns for a stretch of text is an array of
code-point offsets, one for each match: its length is the number of units, and the offsets at two ranks
are where prefix and middle end. A space is always a unit of its own, so a text is cut at spaces first
and each distinct stretch of a batch goes through the pre-tokenizer once; its offsets are shifted to
every place where the stretch stands.

Scale: no shuffle. A task holds one slice of texts (``text.SLICE_BYTES``) and the offsets of its distinct
stretches; a stretch without spaces goes through in parts of ``PART`` code points. The slices of the text
are cut by Spark at the offsets found.

Edge cases: a null text counts as empty; empty texts, and texts that hold a marker already, stay plain;
a null id is hashed as the empty string; repeated rows give equal rows; an empty table gives none; extra
columns are kept (a column that is named as a result is replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import filled, slices, table

#: Fixed values of the transformation.
PATTERN = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED_PERCENT = 90
SUFFIX_FIRST_PERCENT = 20
#: Code points that the pre-tokenizer takes at once.
PART = 1 << 16


def letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


class Units:
    """Where the units of a stretch of text end, from the pre-tokenizer's offsets."""

    def __init__(self, pattern: str = PATTERN):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split = Split(Regex(pattern), "isolated")

    def ends(self, stretch: str) -> np.ndarray:
        parts = []
        for lo in range(0, len(stretch), PART):
            found = self.split.pre_tokenize_str(stretch[lo : lo + PART])
            ends = np.fromiter((end for _, (_, end) in found), np.int64, len(found)) + lo
            hi = min(lo + PART, len(stretch))
            inside = hi < len(stretch) and letter(stretch[hi - 1]) and letter(stretch[hi])
            parts.append(ends[:-1] if inside else ends)  # a run of letters goes on in the next part
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def cuts(self, texts: pa.Array, ranks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Units of each text, and the code-point offsets after ``rank % (units + 1)`` of them, in order."""
        lists = pc.split_pattern(texts, " ")
        at = np.asarray(lists.offsets, dtype=np.int64)
        coded = lists.flatten().dictionary_encode()
        stretches = coded.dictionary.to_pylist()
        ends = [self.ends(s) for s in stretches]
        ids = coded.indices.to_numpy(zero_copy_only=False)
        units = np.fromiter(map(len, ends), np.int64, len(ends))[ids]
        chars = np.fromiter(map(len, stretches), np.int64, len(ends))[ids]
        at = at - at[0]
        n = np.zeros(len(texts), np.int64)
        offsets = np.zeros((len(texts), len(ranks)), np.int64)
        for i, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
            upto, char = np.cumsum(units[lo:hi] + 1), np.cumsum(chars[lo:hi] + 1)  # with the space after each stretch
            n[i] = upto[-1] - 1
            for k, rank in enumerate(sorted(int(r[i]) % (int(n[i]) + 1) for r in ranks)):
                if rank:
                    j = int(np.searchsorted(upto, rank))
                    inside = rank - (int(upto[j - 1]) if j else 0)
                    own = ends[ids[lo + j]]
                    offsets[i, k] = (int(char[j - 1]) if j else 0) + (own[inside - 1] if inside <= len(own) else chars[lo + j] + 1)
        return n, offsets


_units: dict[str, Units] = {}


def _cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    """struct<n, prefix, middle> of each text and its first two numbers."""
    units = _units.setdefault(PATTERN, Units())
    n, offsets = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
    for part in slices(pa.RecordBatch.from_arrays([texts, first, second], ["t", "a", "b"]), "t"):
        found = units.cuts(filled(part.column("t")), [part.column(c).to_numpy() for c in ("a", "b")])
        n.append(found[0])
        offsets.append(found[1])
    at = np.concatenate(offsets)
    return pa.StructArray.from_arrays([pa.array(np.concatenate(n)), pa.array(at[:, 0]), pa.array(at[:, 1] - at[:, 0])], ["n", "prefix", "middle"])


def draw(id_column: str, k: int) -> Column:
    """The k-th number below 2**32 drawn for a row, from 1."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("bigint")


def transform(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars and output."""
    t = F.coalesce(F.col(text), F.lit(""))
    cuts = F.arrow_udf(_cuts, "struct<n:bigint,prefix:bigint,middle:bigint>")
    cut = docs.withColumn("output", F.struct(t.alias("t"), cuts(F.col(text), draw(id_column, 1), draw(id_column, 2)).alias("c")))
    t, c = F.col("output.t"), F.col("output.c")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | t.contains(mark)
    plain = (t == "") | marked | (draw(id_column, 3) % 100 >= TRANSFORMED_PERCENT)
    form = F.when(plain, "plain").when(draw(id_column, 4) % 100 < SUFFIX_FIRST_PERCENT, "spm").otherwise("psm")
    whole = F.char_length(t)
    prefix, middle = F.substring(t, F.lit(1), c["prefix"].cast("int")), F.substring(t, (c["prefix"] + 1).cast("int"), c["middle"].cast("int"))
    suffix = F.substring(t, (c["prefix"] + c["middle"] + 1).cast("int"), whole)
    head, tail = F.concat(F.lit(PREFIX), prefix), F.concat(F.lit(SUFFIX), suffix)
    cut = cut.withColumns({"n": c["n"], "form": form})
    shaped = F.col("form") != "plain"
    cut = cut.withColumns({"prefix_chars": F.when(shaped, c["prefix"]), "middle_chars": F.when(shaped, c["middle"])})
    return cut.withColumn("output", F.when(~shaped, t).otherwise(F.concat(F.when(F.col("form") == "psm", F.concat(head, tail)).otherwise(F.concat(tail, head)), F.lit(MIDDLE), middle)))


def restore(output: Column, form: Column) -> Column:
    """The text before ``transform``: what stands between the markers, back in its order.

    No marker stands in the text, and no end of one is a start of another, so each is found where it was put.
    """
    body = output.substr(F.lit(len(PREFIX) + 1), F.char_length(output))
    before = lambda c, mark: F.substring_index(c, mark, 1)
    after = lambda c, mark: F.substring_index(c, mark, -1)
    middle = after(output, MIDDLE)
    psm = F.concat(before(body, SUFFIX), middle, before(after(body, SUFFIX), MIDDLE))
    spm = F.concat(before(after(body, PREFIX), MIDDLE), middle, before(body, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), restored)


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '{PATTERN}') AS u, list_transform([1, 9, 17, 25], lambda p: list_reduce(list_transform(string_split(substr(s, p, 8), ''), lambda x: (strpos('0123456789abcdef', x) - 1)::BIGINT), lambda a, b: a * 16 + b)) AS h FROM d),
r AS (SELECT *, len(u) AS n, h[1] % (len(u) + 1) AS x, h[2] % (len(u) + 1) AS y,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h[3] % 100 >= {TRANSFORMED_PERCENT} THEN 'plain' WHEN h[4] % 100 < {SUFFIX_FIRST_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, coalesce(array_to_string(u[1:least(x, y)], ''), '') AS p, coalesce(array_to_string(u[least(x, y) + 1:greatest(x, y)], ''), '') AS m, coalesce(array_to_string(u[greatest(x, y) + 1:n], ''), '') AS e FROM r)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || e || '{MIDDLE}' || m ELSE '{SUFFIX}' || e || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(p || m || e) AS restored_sha256 FROM c"""
