"""Writers of tables, catalogues, images, reports and manifests (K1-K8)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vislake.sources.fits import image_bytes, image_cards


def write_table(df: DataFrame, path: str) -> None:
    """A CSV folder with a header; floats in their shortest exact form (K1). An empty table is an error."""
    if df.isEmpty():
        raise ValueError(f"nothing to write to {path}")
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def _text(v: object) -> str:
    if v is None:
        return ""
    if isinstance(v, float):
        return repr(v)
    s = str(v)
    return '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\n ') else s


def write_catalogue(df: DataFrame, folder: str, units: dict[str, str], meta: dict[str, object], order: list[str]) -> list[Path]:
    """The same table as ECSV (typed, with units), CSV and Markdown, in one order (K2, O3). Rows are streamed from the
    driver's iterator, one partition at a time."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    names = {"double": "float64", "float": "float32", "int": "int32", "bigint": "int64", "string": "string", "boolean": "bool"}
    columns = [json.dumps({"name": c, "datatype": names.get(t, "string"), **({"unit": units[c]} if c in units else {})}) for c, t in df.dtypes]
    paths = [out / f"catalogue.{x}" for x in ("ecsv", "csv", "md")]
    head = "# %ECSV 1.0\n# ---\n# delimiter: ','\n# datatype:\n" + "".join(f"# - {c}\n" for c in columns) + "# meta: " + json.dumps(meta) + "\n# schema: astropy-2.0\n"
    with paths[0].open("w") as ecsv, paths[1].open("w") as csv, paths[2].open("w") as md:
        line = ",".join(df.columns)
        ecsv.write(head + line + "\n")
        csv.write(line + "\n")
        md.write("| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n")
        for row in df.orderBy(*order).toLocalIterator():
            line = ",".join(map(_text, row))
            ecsv.write(line + "\n")
            csv.write(line + "\n")
            md.write("| " + " | ".join("" if v is None else str(v) for v in row) + " |\n")
    return paths


def write_images(images: DataFrame, folder: str, date: str, lines: list[str]) -> DataFrame:
    """Registered FITS images, written by the tasks that hold them; returns (source, path, sha256, bytes) (K3, K6).

    images: source, npix, pixel, restored (x fastest), ra_deg, dec_deg, sigma_major, ratio, pa. folder must be one that all
    executors share.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        Path(folder).mkdir(parents=True, exist_ok=True)
        for b in batches:
            out = []
            for r in b.itertuples():
                image = np.asarray(r.restored).reshape(r.npix, r.npix, order="F")
                fwhm = 2 * np.sqrt(2 * np.log(2))
                beam = (r.sigma_major * fwhm, r.sigma_major * r.ratio * fwhm, r.pa)
                raw = image_bytes(image, image_cards(str(r.source), r.npix, r.pixel, r.ra_deg, r.dec_deg, beam, date, lines))
                path = Path(folder) / f"{r.source}.fits"
                path.write_bytes(raw)
                out.append((r.source, str(path), hashlib.sha256(raw).hexdigest(), len(raw)))
            yield pd.DataFrame(out, columns=["source", "path", "sha256", "bytes"])

    kind = dict(images.dtypes)["source"]
    return images.where(F.col("restored").isNotNull()).select("source", "npix", "pixel", "restored", "ra_deg", "dec_deg", "sigma_major", "ratio", "pa").mapInPandas(run, f"source {kind}, path string, sha256 string, bytes bigint")


def write_manifest(folder: str, settings: dict[str, object]) -> Path:
    """manifest.toml with settings and the SHA-256 of every file of a folder, without a time stamp (K7)."""
    root = Path(folder)
    quote = lambda v: json.dumps(str(v) if not isinstance(v, (bool, int, float)) else v)
    lines = ["[settings]", *[f"{k} = {quote(v)}" for k, v in sorted(settings.items())], "", "[files]"]
    for p in sorted(root.rglob("*")):
        if p.is_file() and p.name != "manifest.toml":
            h = hashlib.sha256()
            with p.open("rb") as f:
                while block := f.read(1 << 20):
                    h.update(block)
            lines.append(f"{json.dumps(str(p.relative_to(root)))} = {json.dumps(h.hexdigest())}")
    out = root / "manifest.toml"
    out.write_text("\n".join(lines) + "\n")
    return out


def write_report(folder: str, title: str, facts: dict[str, object], tables: dict[str, DataFrame], most_rows: int | None = None) -> Path:
    """report.md with facts and whole tables, streamed row by row (K7). With most_rows a longer table is an error, not cut."""
    out = Path(folder) / "report.md"
    out.parent.mkdir(parents=True, exist_ok=True)
    with out.open("w") as f:
        f.write("\n".join([f"# {title}", "", *[f"- {k}: {v}" for k, v in facts.items()]]) + "\n")
        for name, df in tables.items():
            f.write(f"\n## {name}\n\n| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n")
            for n, row in enumerate(df.toLocalIterator()):
                if most_rows is not None and n >= most_rows:
                    raise ValueError(f"{name} has more than {most_rows} rows")
                f.write("| " + " | ".join(map(str, row)) + " |\n")
    return out
