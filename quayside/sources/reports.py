"""Reports from small frames: Markdown tables with provenance, SVG frontiers, manifests. Host-side by nature.

Frames given here are results of aggregations over arms or strata; more rows than a report shows is an error, not a cut.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 5_000


def small_rows(frame: DataFrame, order: Sequence[str]) -> list:
    rows = frame.orderBy(*order).limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows for a report")
    return rows


def cell(value) -> str:
    return "" if value is None else f"{value:.6g}" if isinstance(value, float) else str(value).replace("|", "\\|")


def markdown(frame: DataFrame, order: Sequence[str], provenance: str) -> str:
    """A table in which every row carries where it comes from."""
    head = [*frame.columns, "provenance"]
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    lines += ["| " + " | ".join([*map(cell, r), provenance]) + " |" for r in small_rows(frame, order)]
    return "\n".join(lines) + "\n"


def untraced_rows(text: str) -> list[str]:
    """Table rows of a Markdown text whose last cell is empty."""
    rows = [line for line in text.splitlines() if line.startswith("|") and not set(line) <= set("|-: ")]
    return [r for r in rows if not r.rstrip("|").rpartition("|")[2].strip()]


def digest(frame: DataFrame) -> DataFrame:
    """n and a digest of all rows that does not depend on their order: the sum of their hashes modulo 2^64, in hex."""
    hashed = frame.select(F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(frame.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("h"))
    return hashed.agg(F.count("*").alias("n"), F.lower(F.lpad(F.conv((F.coalesce(F.sum("h"), F.lit(0)) % (1 << 60)).cast("string"), 10, 16), 15, "0")).alias("digest"))


def frontier_svg(frame: DataFrame, name: str, budget: str, reward: str, title: str, size: tuple[int, int] = (640, 400)) -> str:
    """Points and the line through them, scaled to the frame."""
    rows, (w, h), pad = small_rows(frame.select(name, budget, reward), [budget, name]), size, 40
    xs, ys = [float(r[1]) for r in rows], [float(r[2]) for r in rows]
    at = lambda v, values, low, high: low + (high - low) * ((v - min(values)) / (max(values) - min(values)) if max(values) > min(values) else 0.5)
    points = [(at(x, xs, pad, w - pad), at(y, ys, h - pad, pad)) for x, y in zip(xs, ys, strict=True)]
    line = " ".join(f"{x:.1f},{y:.1f}" for x, y in points)
    marks = "".join(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="4"/><text x="{x + 6:.1f}" y="{y:.1f}" font-size="11">{escape(str(r[0]))}</text>' for (x, y), r in zip(points, rows, strict=True))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}"><title>{escape(title)}</title><polyline fill="none" stroke="black" points="{line}"/>{marks}</svg>\n'


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def manifest(artifacts: Mapping[str, str], inputs: DataFrame | None = None) -> str:
    """JSON with the SHA-256 of each artifact's text and, if given, the inputs' count and digest; the same for the same contents."""
    out: dict = {"artifacts": {name: hashlib.sha256(text.encode()).hexdigest() for name, text in sorted(artifacts.items())}}
    if inputs is not None:
        row = digest(inputs).first()
        out["inputs"] = {"rows": row.n, "digest": row.digest}
    return json.dumps(out, sort_keys=True, indent=1) + "\n"


def write(folder: str, artifacts: Mapping[str, str]) -> None:
    """Write artifacts on the driver's host; existing files are refused."""
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    for name, text in artifacts.items():
        with (root / name).open("x") as f:
            f.write(text)


def read_yaml(text: str) -> dict:
    """A YAML mapping without repeated keys. Needs PyYAML, which is optional."""
    import yaml

    class Strict(yaml.SafeLoader):
        pass

    def mapping(loader, node, deep=False):
        keys = [loader.construct_object(k, deep=deep) for k, _ in node.value]
        if len(set(map(str, keys))) < len(keys):
            raise ValueError(f"repeated key near line {node.start_mark.line + 1}")
        return yaml.SafeLoader.construct_mapping(loader, node, deep)

    Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return yaml.load(text, Strict)
