"""Scalar expressions as Columns: names, sizes, shapes, and the ratio predictors. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

import fnmatch
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layer kinds in order of precedence, with the patterns that name them (case-insensitive; _ is a wildcard).
LAYER_PATTERNS = (
    ("q_proj", ("%q_proj%",)),
    ("k_proj", ("%k_proj%",)),
    ("v_proj", ("%v_proj%",)),
    ("o_proj", ("%o_proj%",)),
    ("gate_proj", ("%gate_proj%", "%gate_up%")),
    ("up_proj", ("%up_proj%",)),
    ("down_proj", ("%down_proj%",)),
    ("embed", ("%embed%",)),
    ("lm_head", ("%lm_head%", "%embed_out%")),
    ("norm", ("%layernorm%", "%layer_norm%", "%norm%")),
)
# Bytes of an element.
ITEM_BYTES = {"bool": 1, "uint8": 1, "int8": 1, "int16": 2, "uint16": 2, "float16": 2, "bfloat16": 2, "int32": 4, "uint32": 4, "float32": 4, "int64": 8, "uint64": 8, "float64": 8}
# Coefficients of the ratio predictor (p, t, p*t, 1), and of its published refit.
COEFFS = (-23.727944, 0.522466, 1.966862, -0.043132)
REFIT = (-6.0383, 0.1553, 0.6240, 0.0135)
# The distance-to-ratio curve.
KNEE, LOW_MAX, LOW_SCALE, LOW_POWER = 8.75e-04, 0.653618, 1.34e-04, 0.496238
HIGH_MIN, HIGH_MAX, HIGH_SCALE = 0.742603, 1.037701, 2.942e-03
# Short names, applied in this order.
SHORT_NAMES = (("self_attn.", "attn."), ("input_layernorm", "in_ln"), ("post_attention_layernorm", "post_ln"), ("q_proj", "q"), ("k_proj", "k"), ("v_proj", "v"), ("o_proj", "o"), ("gate_proj", "gate"), ("up_proj", "up"), ("down_proj", "down"), (".weight", ""), (".bias", ".b"))
# Size units.
UNITS = {"": 1, "B": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12, "KIB": 2**10, "MIB": 2**20, "GIB": 2**30, "TIB": 2**40}


def layer_type(name: Column) -> Column:
    """B1: one search for each pattern in the name in lower case, a wildcard as any character"""
    low = F.lower(name)
    hit = lambda p: low.rlike(p.strip("%").replace("_", ".")) if "_" in p else low.contains(p.strip("%"))
    out = F
    for kind, patterns in LAYER_PATTERNS:
        some = hit(patterns[0])
        for p in patterns[1:]:
            some = some | hit(p)
        out = out.when(some, kind)
    return out.otherwise("other")


def layer_types(df, name: str = "name", kind: str = "kind"):
    """B1 on a table: each distinct name is looked at once, and its kind joined back"""
    kinds = df.select(name).distinct().withColumn(kind, layer_type(F.col(name)))
    return df.join(kinds, df[name].eqNullSafe(kinds[name]), "left").drop(kinds[name])


def like_any_case(name: Column, pattern: str) -> Column:
    """The LIKE of a store whose LIKE ignores ASCII case"""
    return name.ilike(pattern)


def glob(name: Column, pattern: str) -> Column:
    """Shell pattern, case-sensitive, the whole name"""
    body = fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$")
    return name.rlike("^" + body)


def parse_size(text: Column) -> Column:
    """B7: '5GB' -> 5 * 10**9, '5GiB' -> 5 * 2**30, bare numbers are bytes; anything else is null"""
    number = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*$", 1)
    unit = F.upper(F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*$", 2))
    factor = F
    for u, f in UNITS.items():
        factor = factor.when(unit == u, F.lit(f).cast("double"))
    return F.when(number != "", F.floor(F.expr("try_cast(1 as double)") * number.cast("double") * factor).cast("long"))


def format_size(n: Column) -> Column:
    """Steps of 1024; whole bytes, else one decimal; TiB at most"""
    out = F.when(n < 1024, F.format_string("%d B", n.cast("long")))
    for i, unit in enumerate(("KiB", "MiB", "GiB"), 1):
        out = out.when(n < F.lit(float(1024 ** (i + 1))), F.format_string(f"%.1f {unit}", n / F.lit(float(1024**i))))
    return out.otherwise(F.format_string("%.1f TiB", n / F.lit(float(1024**4))))


def item_bytes(dtype: Column) -> Column:
    """Null for a kind that isn't known"""
    out = F
    for k, v in ITEM_BYTES.items():
        out = out.when(F.regexp_replace(dtype, r"^torch\.", "") == k, v)
    return out.otherwise(F.lit(None).cast("int"))


def numel(shape: Column) -> Column:
    """1 for a scalar's empty shape"""
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)


def logical_bytes(shape: Column, dtype: Column) -> Column:
    """0 for a kind that isn't known"""
    return numel(shape) * F.coalesce(item_bytes(dtype), F.lit(0))


def split_ref(ref: Column) -> tuple[Column, Column]:
    """Model and parameter, at the first colon"""
    at = F.instr(ref, ":")
    return F.when(at > 0, F.substring(ref, F.lit(1), at - 1)), F.when(at > 0, F.substring(ref, at + 1, F.length(ref)))


def parse_shape(text: Column) -> Column:
    """B13: '[2,3]' or '(2, 3)' -> array; anything else is the empty shape"""
    inner = F.regexp_replace(F.regexp_extract(text, r"^\s*[\[(]\s*((?:[0-9]+\s*,?\s*)*)[\])]\s*$", 1), r"\s|,\s*$", "")
    return F.when(inner == "", F.array().cast("array<bigint>")).otherwise(F.split(inner, ",").cast("array<bigint>"))


def binary_entropy(p: Column) -> Column:
    """0 outside (1e-15, 1 - 1e-15)"""
    return F.when((p > 1e-15) & (p < 1 - 1e-15), -p * F.log2(p) - (1 - p) * F.log2(1 - p)).otherwise(F.lit(0.0))


def predict_ratio(p: Column, coeffs=COEFFS) -> Column:
    """Not monotone, by its coefficients"""
    a, b, c, d = coeffs
    q = F.greatest(F.lit(0.0), F.least(F.lit(0.5), p))
    t = 8 * binary_entropy(q)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), a * q + b * t + c * q * t + d))


def poly2(p: Column, coeffs: tuple[float, float, float]) -> Column:
    """B16"""
    t = 8 * binary_entropy(p)
    return coeffs[0] + coeffs[1] * t + coeffs[2] * t * t


def curve_ratio(d: Column) -> Column:
    """A stretched exponential up to the knee, then an exponential anchored there, clipped to the range of both"""
    x = F.greatest(F.lit(0.0), d)
    low = F.lit(LOW_MAX) * (1 - F.exp(-F.pow(x / LOW_SCALE, F.lit(LOW_POWER))))
    knee = LOW_MAX * (1 - math.exp(-((KNEE / LOW_SCALE) ** LOW_POWER)))
    high = lambda v: HIGH_MIN + (HIGH_MAX - HIGH_MIN) * (1 - math.exp(-v / HIGH_SCALE))
    far = F.lit(HIGH_MIN) + (HIGH_MAX - HIGH_MIN) * (1 - F.exp(-x / HIGH_SCALE)) - high(KNEE) + knee
    least = min(0.0, knee, high(0.0) - high(KNEE) + knee)
    most = max(LOW_MAX, (HIGH_MAX - HIGH_MIN) * math.exp(-KNEE / HIGH_SCALE) + knee)
    return F.greatest(F.lit(least), F.least(F.lit(most), F.when(x <= KNEE, low).otherwise(far)))


def zigzag(n: Column) -> Column:
    """Of 16-bit values held in an int"""
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 15))


def unzigzag(n: Column) -> Column:
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-(n.bitwiseAND(F.lit(1))))


def short_name(name: Column) -> Column:
    """B23 (the two patterns are fixed values)"""
    layer = F.regexp_extract(name, r"layers\.(\d+)\.", 1)
    out = F.regexp_replace(F.regexp_replace(name, r"^(model\.)?layers\.\d+\.", ""), r"^model\.", "")
    for old, new in SHORT_NAMES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.when(layer != "", F.concat(F.lit("layer"), layer, F.lit("."), out)).otherwise(out)


def safe_file_name(name: Column) -> Column:
    """B24"""
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")


def year_fraction(ts: Column) -> Column:
    """B25"""
    return F.year(ts) + (F.month(ts) - 1) / 12


def bits_to_ratio(h: Column) -> Column:
    """Entropy in bits a byte as a share; null counts as 0"""
    return F.coalesce(h, F.lit(0.0)) / 8


def valid_blob_id(name: Column) -> Column:
    """B28"""
    return (F.length(name) > 0) & ~name.contains("/") & ~name.contains("\\") & ~name.contains("..")


def blob_answer(blob_id: Column, size: Column, ranges: Column, known: Column) -> Column:
    """How a request for a blob is answered: struct (status, first, last), the bytes sent being first to last.

    400 for what is no id, 404 where there is no blob (size null), 304 if `known` (a list of quoted ids) has it, 416 for a range that is
    not one single range of bytes inside the blob, 206 for a range, 200 for all. The end of a range may lie beyond the blob.
    """
    spec = F.regexp_extract(ranges, r"^bytes=(\d*)-(\d*)$", 0)
    a, b = (F.nullif(F.regexp_extract(ranges, r"^bytes=(\d*)-(\d*)$", i), F.lit("")).try_cast("bigint") for i in (1, 2))
    first = F.when(a.isNull(), F.greatest(F.lit(0).cast("long"), size - b)).otherwise(a)
    last = F.when(a.isNull() | b.isNull(), size - 1).otherwise(F.least(b, size - 1))
    wrong = (spec == "") | (a.isNull() & (b.isNull() | (b == 0))) | (first >= size) | (last < first)
    etag = F.exists(F.split(known, ","), lambda x: F.trim(x) == F.concat(F.lit('"'), blob_id, F.lit('"')))
    status = F.when(~valid_blob_id(blob_id), 400).when(size.isNull(), 404).when(F.coalesce(etag, F.lit(False)), 304).when(ranges.isNull(), 200).when(wrong, 416).otherwise(206)
    sent = lambda x, whole: F.when(status == 206, x).when(status == 200, whole)
    return F.struct(status.alias("status"), sent(first, F.lit(0).cast("long")).alias("first"), sent(last, size - 1).alias("last"))
