"""FITS as a Spark source and as bytes (S1, S2, K3, K4): cards, images and binary tables.

The data source reads one table extension of any size: each partition seeks to its own range of fixed-length rows, so a
file is never held as a whole. It needs paths that executors can open (a mounted file system).
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

BLOCK, CARD = 2880, 80


def value_text(v: object) -> str:
    """The value field of a card: 20 columns, numbers to the right."""
    if isinstance(v, bool):
        return ("T" if v else "F").rjust(20)
    if isinstance(v, (int, np.integer)):
        return str(int(v)).rjust(20)
    if isinstance(v, (float, np.floating)):
        s = repr(float(v)).replace("e", "E")
        if len(s) > 20:
            mantissa, e, exponent = s.partition("E")
            s = mantissa[: 20 - len(e + exponent)] + e + exponent
        return s.rjust(20)
    return ("'" + str(v).replace("'", "''").ljust(8) + "'").ljust(20)


def card(key: str, value: object, comment: str = "") -> bytes:
    """One 80-byte card."""
    if len(key) > 8:
        raise ValueError(f"keyword {key} is longer than 8 characters")
    return (key.ljust(8) + "= " + value_text(value) + (f" / {comment}" if comment else "")).encode()[:CARD].ljust(CARD)


def history(text: str) -> list[bytes]:
    """HISTORY cards of at most 72 characters each."""
    raw = text.encode()
    return [(b"HISTORY ".ljust(8) + raw[k : k + 72]).ljust(CARD) for k in range(0, max(len(raw), 1), 72)]


def padded(raw: bytes, fill: bytes = b"\0") -> bytes:
    """To a whole number of blocks."""
    return raw + fill * (-len(raw) % BLOCK)


def header(cards: list[bytes]) -> bytes:
    """Cards, END and blanks."""
    return padded(b"".join([*cards, b"END".ljust(CARD)]), b" ")


def parse_cards(raw: bytes) -> dict[str, object]:
    """Keyword -> value of a header's bytes; HISTORY and COMMENT are joined lists."""
    out: dict[str, object] = {}
    for k in range(0, len(raw), CARD):
        line = raw[k : k + CARD].decode("latin-1")
        key = line[:8].strip()
        if key in ("HISTORY", "COMMENT"):
            out.setdefault(key, []).append(line[8:].rstrip())  # type: ignore[union-attr]
        elif line[8:10] == "= ":
            text = line[10:]
            m = re.match(r"\s*'((?:[^']|'')*)'", text)
            v = m[1].replace("''", "'").rstrip() if m else text.partition("/")[0].strip()
            if not m:
                v = True if v == "T" else False if v == "F" else int(v) if re.fullmatch(r"[+-]?\d+", v) else float(v.replace("D", "E")) if v else None
            out[key] = v
    return out


def read_header(f: io.BufferedIOBase) -> dict[str, object] | None:
    """The next header of an open file; None at its end."""
    raw = b""
    while True:
        block = f.read(BLOCK)
        if len(block) < BLOCK:
            return None
        raw += block
        if any(block[k : k + 8] == b"END     " for k in range(0, BLOCK, CARD)):
            return parse_cards(raw)


def data_bytes(h: dict) -> int:
    """Length of the data after a header, without padding."""
    n = int(h.get("NAXIS", 0))
    axes = [int(h[f"NAXIS{k}"]) for k in range(1, n + 1)]
    if not axes:
        return 0
    if axes[0] == 0 and h.get("GROUPS"):
        axes = axes[1:]
    return abs(int(h["BITPIX"])) // 8 * int(h.get("GCOUNT", 1)) * (int(h.get("PCOUNT", 0)) + int(np.prod(axes)))


def image_bytes(image: np.ndarray, cards: list[bytes]) -> bytes:
    """A primary image of 32-bit floats; image[x, y] with x = East, written with right ascension falling (K3)."""
    n, m = image.shape
    first = [card("SIMPLE", True, "conforms to FITS standard"), card("BITPIX", -32, "array data type"), card("NAXIS", 2, "number of array dimensions"), card("NAXIS1", n), card("NAXIS2", m)]
    return header(first + cards) + padded(image[::-1].astype(">f4").tobytes(order="F"))


def image_cards(source: str, npix: int, pixel: float, ra_deg: float, dec_deg: float, beam: tuple[float, float, float], date: str, lines: list[str]) -> list[bytes]:
    """World coordinates, beam (mas, mas, rad) and history of a registered image (K3)."""
    deg = 3.6e6
    cards = [card("BUNIT", "JY/BEAM"), card("OBJECT", source), card("DATE-OBS", date), card("CTYPE1", "RA---SIN"), card("CRPIX1", float(npix - npix // 2)), card("CRVAL1", ra_deg), card("CDELT1", -pixel / deg), card("CTYPE2", "DEC--SIN"), card("CRPIX2", float(npix // 2 + 1)), card("CRVAL2", dec_deg), card("CDELT2", pixel / deg), card("EQUINOX", 2000.0), card("BMAJ", beam[0] / deg), card("BMIN", beam[1] / deg), card("BPA", float(np.degrees(beam[2])))]
    return cards + [c for line in lines for c in history(line)]


def registered_copy(raw: bytes, ra_deg: float, dec_deg: float, lines: list[str]) -> bytes:
    """A FITS file with CRVAL1, CRVAL2 replaced and HISTORY added to its primary header; everything after it unchanged (K4)."""
    f = io.BytesIO(raw)
    if read_header(f) is None:
        raise ValueError("no header")
    end = f.tell()
    cards = [raw[k : k + CARD] for k in range(0, end, CARD)]
    cards = cards[: next(k for k, c in enumerate(cards) if c[:8] == b"END     ")]
    new = {b"CRVAL1  ": card("CRVAL1", ra_deg), b"CRVAL2  ": card("CRVAL2", dec_deg)}
    body = raw[end:].replace(b"XTENSION= 'A3DTABLE'", b"XTENSION= 'BINTABLE'")
    return header([new.get(c[:8], c) for c in cards] + [c for line in lines for c in history(line)]) + body


_TYPES = {"L": ("i1", BooleanType()), "B": ("u1", ShortType()), "I": (">i2", ShortType()), "J": (">i4", IntegerType()), "K": (">i8", LongType()), "E": (">f4", FloatType()), "D": (">f8", DoubleType()), "A": ("S", StringType()), "C": (">c8", FloatType()), "M": (">c16", DoubleType())}


#: Name under which the random groups of a UVFITS file are read as a table of params and data.
GROUPS = "GROUPS"


@dataclass(frozen=True)
class Table:
    """Place and layout of a table extension."""

    start: int
    rows: int
    dtype: np.dtype
    fields: list[tuple[str, str, int]]
    cards: dict

    def schema(self) -> StructType:
        """Spark types; repeated fields are arrays, complex numbers are pairs in one flat array."""
        out = []
        for name, code, repeat in self.fields:
            t = _TYPES[code][1]
            single = code == "A" or (repeat == 1 and code not in "CM" and self.dtype[name].shape == ())
            out.append(StructField(name, t if single else ArrayType(t)))
        return StructType(out)


def find_table(path: str, extension: str) -> Table:
    """The first table extension of a name (EXTNAME), or the random groups of the primary part (GROUPS); a missing one is
    an error."""
    with open(path, "rb") as f:
        while (h := read_header(f)) is not None:
            at = f.tell()
            if extension.upper() == GROUPS and h.get("GROUPS") is True and h.get("NAXIS1") == 0:
                n = int(np.prod([int(h[f"NAXIS{k}"]) for k in range(2, int(h["NAXIS"]) + 1)]))
                code = {-32: "E", -64: "D", 16: "I", 32: "J"}[int(h["BITPIX"])]
                fields = [("params", code, int(h["PCOUNT"])), ("data", code, n)]
                return Table(at, int(h["GCOUNT"]), np.dtype([(name, _TYPES[code][0], (r,)) for name, _, r in fields]), fields, h)
            if str(h.get("EXTNAME", "")).strip().upper() == extension.upper() and str(h.get("XTENSION", "")).strip() in ("BINTABLE", "A3DTABLE"):
                fields = []
                for k in range(1, int(h["TFIELDS"]) + 1):
                    m = re.match(r"(\d*)([A-Z])", str(h[f"TFORM{k}"]).strip())
                    fields.append((re.sub(r"\W+", "_", str(h.get(f"TTYPE{k}", f"c{k}")).strip().lower()), m[2], int(m[1] or 1)))
                dtype = np.dtype([(n, f"S{r}" if c == "A" else _TYPES[c][0], () if c == "A" or r == 1 else (r,)) for n, c, r in fields])
                if dtype.itemsize != int(h["NAXIS1"]):
                    raise ValueError(f"row length {h['NAXIS1']}, fields take {dtype.itemsize}")
                return Table(at, int(h["NAXIS2"]), dtype, fields, h)
            f.seek(at + data_bytes(h) + (-data_bytes(h) % BLOCK))
    raise ValueError(f"{path} has no table {extension}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.extension = options["path"], options["extension"]
        self.rows = int(options.get("rowsperpartition", 100_000))

    def partitions(self) -> list[InputPartition]:
        n = find_table(self.path, self.extension).rows
        return [InputPartition(k) for k in range(0, n, self.rows)] or [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        t = find_table(self.path, self.extension)
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(t.schema())
        last = min(partition.value + self.rows, t.rows)
        with open(self.path, "rb") as f:
            f.seek(t.start + partition.value * t.dtype.itemsize)
            for k in range(partition.value, last, 4096):
                n = min(4096, last - k)
                block = np.frombuffer(f.read(n * t.dtype.itemsize), t.dtype)
                yield pa.RecordBatch.from_arrays([_column(block[name], code, field.type) for (name, code, _), field in zip(t.fields, schema)], schema=schema)


def _column(x: np.ndarray, code: str, kind: pa.DataType) -> pa.Array:
    """One field's values as Arrow."""
    if code == "A":
        return pa.array([v.decode("latin-1").rstrip(" \0") for v in x.tolist()], kind)
    if code == "L":
        x = x == ord("T")
    if code in "CM":
        x = np.stack([x.real, x.imag], -1).reshape(len(x), -1)
    x = x.astype(x.dtype.newbyteorder("=")) if x.dtype.kind != "b" else x
    if x.ndim == 1:
        return pa.array(x).cast(kind)
    flat = pa.array(np.ascontiguousarray(x).ravel()).cast(kind.value_type)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat).cast(kind)


class FitsTable(DataSource):
    """spark.read.format("fits_table").option("extension", NAME).load(path)."""

    @classmethod
    def name(cls) -> str:
        return "fits_table"

    def schema(self) -> StructType:
        return find_table(self.options["path"], self.options["extension"]).schema()

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_table(spark: SparkSession, path: str, extension: str, rows_per_partition: int = 100_000) -> DataFrame:
    """One table extension of a file."""
    spark.dataSource.register(FitsTable)
    return spark.read.format("fits_table").option("extension", extension).option("rowsPerPartition", rows_per_partition).load(path)


def _axes(cards: dict, prefix: str) -> dict[str, int]:
    """Axis name -> length, in file order."""
    return {str(cards[f"CTYPE{k}"]).strip().upper(): int(cards[f"{prefix}{k}"]) for k in range(1, 20) if f"CTYPE{k}" in cards and f"{prefix}{k}" in cards}


def load_groups(spark: SparkSession, path: str) -> DataFrame:
    """Long visibilities of a UVFITS file's random groups, with the columns of load_visibilities.

    Parameters of one name add up (two dates); u, v, w are in seconds in the file. Without INTTIM it is an error.
    """
    cards = find_table(path, GROUPS).cards
    axes = _axes(cards, "NAXIS")
    nc, ns, nf, nb = axes.get("COMPLEX", 3), axes.get("STOKES", 1), axes.get("FREQ", 1), axes.get("IF", axes.get("BAND", 1))
    names = [str(cards[f"PTYPE{k}"]).strip().upper() for k in range(1, int(cards["PCOUNT"]) + 1)]

    def param(*wanted: str):
        at = [k for k, n in enumerate(names) if n in wanted or n.split("-")[0] in wanted]
        if not at:
            return None
        scaled = [F.element_at("params", k + 1).cast("double") * float(cards.get(f"PSCAL{k + 1}", 1.0)) + float(cards.get(f"PZERO{k + 1}", 0.0)) for k in at]
        return sum(scaled[1:], scaled[0])

    if param("INTTIM") is None:
        raise ValueError("the groups have no INTTIM parameter")
    raw = read_table(spark, path, GROUPS)
    source = param("SOURCE")
    base = raw.select(F.monotonically_increasing_id().alias("row_id"), F.floor(param("BASELINE") + 1e-3).cast("int").alias("bl"), (F.lit(1) if source is None else F.rint(source).cast("int")).alias("source"), param("DATE", "_DATE").alias("jd"), param("INTTIM").alias("int_time"), *[(param(c) * 299_792_458.0).alias(f"{k}_m") for c, k in (("UU", "u"), ("VV", "v"), ("WW", "w"))], "data")
    day = base.agg(F.min(F.floor(F.col("jd") - 0.5) + 0.5)).first()[0]
    e = base.withColumn("t", (F.col("jd") - day) * 86400.0).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(ns * nf * nb - 1))))
    at = lambda j: F.element_at("data", F.col("k") * nc + j + 1).cast("double")
    band = F.floor(F.col("k") / (ns * nf)).cast("int")
    p, q = F.floor(F.col("bl") / 256).cast("int"), F.col("bl") % 256
    w = F.greatest(at(2), F.lit(0.0)) if nc == 3 else F.lit(1.0)
    out = e.select("row_id", p.alias("p"), q.alias("q"), "source", "t", "int_time", "u_m", "v_m", "w_m", (F.floor(F.col("k") / ns) + 1).cast("int").alias("chan"), (band + 1).alias("if_id"), (F.col("k") % ns + 1).alias("prod"), at(0).alias("re"), at(1).alias("im"), w.alias("w"))
    return out.where("p <> q")


def load(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """Path -> long visibilities; whether a file is FITS-IDI or UVFITS is seen from its first header (S1, S2). Files are put
    together by combine."""
    out = {}
    for path in paths:
        with open(path, "rb") as f:
            first = read_header(f) or {}
        groups = first.get("GROUPS") is True and first.get("NAXIS1") == 0
        out[path] = load_groups(spark, path) if groups else load_visibilities(spark, path)
    return out


def load_visibilities(spark: SparkSession, path: str) -> DataFrame:
    """Long visibilities of a FITS-IDI file (S1): row_id, p, q, source, t, int_time, u_m, v_m, w_m, chan, if_id, prod, re, im, w.

    The UV_DATA matrix is read with its axes COMPLEX (2, or 3 with weights), STOKES, FREQ, BAND; without weights in it the
    WEIGHT column holds one per (stokes, band). Autocorrelations are dropped, negative weights count as 0. int_time
    (INTTIM) is required. t is seconds after the first day's midnight.
    """
    t = find_table(path, "UV_DATA")
    axes = _axes(t.cards, "MAXIS")
    nc, ns, nf, nb = axes.get("COMPLEX", 2), axes.get("STOKES", 1), axes.get("FREQ", 1), axes.get("BAND", 1)
    raw = read_table(spark, path, "UV_DATA")
    if "inttim" not in raw.columns:
        raise ValueError("UV_DATA has no INTTIM column")
    source = next((c for c in ("source", "source_id") if c in raw.columns), None)
    name = lambda c: next(x for x in raw.columns if x == c or x.startswith(c + "_"))
    day = raw.agg(F.min(name("date"))).first()[0]
    e = raw.select(F.monotonically_increasing_id().alias("row_id"), F.col("baseline").cast("int").alias("bl"), (F.col(source).cast("int") if source else F.lit(1)).alias("source"), ((F.col(name("date")) - day + F.col("time")) * 86400.0).alias("t"), F.col("inttim").cast("double").alias("int_time"), *[(F.col(name(c)) * 299_792_458.0).alias(f"{k}_m") for c, k in (("uu", "u"), ("vv", "v"), ("ww", "w"))], "flux", *(["weight"] if "weight" in raw.columns else []), F.explode(F.sequence(F.lit(0), F.lit(ns * nf * nb - 1))).alias("k"))
    at = lambda j: F.element_at("flux", F.col("k") * nc + j + 1).cast("double")
    prod, band = F.col("k") % ns, F.floor(F.col("k") / (ns * nf)).cast("int")
    w = at(2) if nc == 3 else F.element_at("weight", band * ns + prod + 1).cast("double") if "weight" in raw.columns else F.lit(1.0)
    p, q = F.floor(F.col("bl") / 256).cast("int"), F.col("bl") % 256
    out = e.select("row_id", p.alias("p"), q.alias("q"), "source", "t", "int_time", "u_m", "v_m", "w_m", (F.floor(F.col("k") / ns) + 1).cast("int").alias("chan"), (band + 1).alias("if_id"), (prod + 1).alias("prod"), at(0).alias("re"), at(1).alias("im"), F.greatest(w, F.lit(0.0)).alias("w"))
    return out.where("p <> q")


def table_bytes(name: str, columns: dict[str, np.ndarray], more: list[bytes] | None = None) -> bytes:
    """A binary table extension from equal-length arrays (for fixtures and exports)."""
    code = {"f4": "E", "f8": "D", "i4": "J", "i8": "K", "i2": "I"}
    n = len(next(iter(columns.values())))
    big = {k: v.astype(v.dtype.newbyteorder(">")) if v.dtype.kind != "S" else v for k, v in columns.items()}
    rec = np.zeros(n, np.dtype([(k, v.dtype, v.shape[1:]) for k, v in big.items()]))
    for k, v in big.items():
        rec[k] = v
    cards = [b"XTENSION= 'BINTABLE'".ljust(CARD), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", rec.dtype.itemsize), card("NAXIS2", n), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", len(big))]
    for i, (k, v) in enumerate(big.items(), 1):
        cards += [card(f"TTYPE{i}", k), card(f"TFORM{i}", f"{v.dtype.itemsize}A" if v.dtype.kind == "S" else f"{int(np.prod(v.shape[1:]) or 1)}{code[v.dtype.str[1:]]}")]
    return header([*cards, card("EXTNAME", name), *(more or [])]) + padded(rec.tobytes())
