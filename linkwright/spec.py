"""What a linkage does: layouts of tables, and the configuration of a run, also from XML."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql.types import IntegerType, StringType, StructField, StructType


def _strings(*names: str, **more) -> StructType:
    return StructType([StructField(n, StringType()) for n in names] + [StructField(n, t) for n, t in more.items()])


#: All attributes are strings: leading zeros count, and dates are compared digit by digit.
LAYOUTS: dict[str, StructType] = {
    "two_col": _strings("ssn", "name"),
    "full_name": _strings("ssn", "name", "dod", "dob"),
    "first_last": _strings("ssn", "first", "last", "dod", "dob"),
    "voter": _strings("recid", "first", "last", "suburb", "postcode", source=IntegerType()),
    "voter_source": _strings("recid", "first", "last", "suburb", "postcode"),
    "k_distant": _strings("ssn", "name", "dod", "dob", "tag"),
}


@dataclass
class Comparison:
    """One term of a configured distance: the metric's number, attribute places, weight and options."""

    method: int
    attributes: list[int]
    weight: float = 1.0
    truncate: int | None = None


@dataclass
class LinkageSpec:
    entity: str = "entity_id"
    rec: str = "rec_idx"
    source: str | None = None
    compare: list[str] = field(default_factory=list)
    block: str = ""
    block_kind: str = "super"
    k: int = 3
    limits: list[int] = field(default_factory=list)
    total: int = 1
    refinement: str | None = None
    headless: bool = True
    # what XML configurations hold besides
    files: list[str] = field(default_factory=list)
    attribute_maps: list[list[int]] = field(default_factory=list)
    comparisons: list[Comparison] = field(default_factory=list)
    block_fields: list[tuple[int, str, int]] = field(default_factory=list)
    priority: list[int] = field(default_factory=list)
    threshold: float = 1.0
    row_cap: int | None = None
    output: str | None = None
    log: str | None = None

    @classmethod
    def from_xml(cls, xml: str) -> LinkageSpec:
        """Read a configuration text, by its root: `febrl-config`, `rla-config` (fixed formats, see `_from_formats`) or `linkage`; any other is an error.
        Elements of the last: dataset (file, map), threshold, comparison (method, attributes, weight, truncate), block (field, kind,
        length), priority, row-cap, output, log. Unknown elements are ignored; a missing one keeps its default."""
        root = ET.fromstring(xml)
        if root.tag in ("febrl-config", "rla-config"):
            return cls._from_formats(root)
        if root.tag != "linkage":
            raise ValueError(f"no configuration has the root {root.tag!r}")
        numbers = lambda s: [int(x) for x in (s or "").replace(",", " ").split()]
        out = cls()
        for d in root.iter("dataset"):
            out.files.append((d.findtext("file") or "").strip())
            out.attribute_maps.append(numbers(d.findtext("map")))
        for c in root.iter("comparison"):
            cut = c.findtext("truncate")
            out.comparisons.append(Comparison(int(c.findtext("method") or 0), numbers(c.findtext("attributes")), float(c.findtext("weight") or 1), int(cut) if cut else None))
        for b in root.iter("block"):
            out.block_fields.append((int(b.findtext("field") or 0), (b.findtext("kind") or "alpha").strip(), int(b.findtext("length") or 3)))
        out.threshold = float(root.findtext(".//threshold") or out.threshold)
        out.priority = numbers(root.findtext(".//priority"))
        cap = root.findtext(".//row-cap")
        out.row_cap = int(cap) if cap else None
        out.output, out.log = root.findtext(".//output"), root.findtext(".//log")
        return out

    @classmethod
    def _from_formats(cls, root: ET.Element) -> LinkageSpec:
        """The two formats in which each setting has its text in an element `value`. Numbers of methods count from 1 there, so edit distance, reversal and truncation
        are 1, 2 and 3, and q-grams, Hausdorff and Jaro-Winkler 5, 6 and 7; types of blocks are 0 for letters and 1 for digits."""
        numbers = lambda s: [int(x) for x in (s or "").replace(",", " ").split()]
        value = lambda e, path="": ((e.findtext(f"{path}/value" if path else "value") or "") if e is not None else "").strip()
        out = cls()
        for d in root.findall("dataset"):
            out.files.append(value(d))
            out.attribute_maps.append(numbers(value(d, "dataset_index")))
        param = root.find("version-config-param")
        if param is None:
            raise ValueError("a configuration needs version-config-param")
        weights = numbers(value(root, "weights"))
        for i, c in enumerate(param.findall("comparison")):
            method, cut = int(value(c, "dist_calc_method") or 1), value(c, "truncate_count")
            out.comparisons.append(Comparison(method - 1 if method < 5 else method, numbers(value(c, "comparing_attribute_indices")), float(weights[i]) if i < len(weights) else 1.0, int(cut) if cut else None))
        threshold = value(param, "threshold")
        out.threshold = float(threshold) if threshold else out.threshold
        block = param.find("block")
        if block is not None:
            types = numbers(value(block, "type"))
            out.block_fields = [(i, "digit" if k < len(types) and types[k] == 1 else "alpha", n) for k, (i, n) in enumerate(zip(numbers(value(block, "index")), numbers(value(block, "length")), strict=True))]
        last_name = value(param, "last_name_index")
        if last_name and not out.block_fields:
            out.block_fields = [(int(last_name), "alpha", out.k)]
        out.priority = numbers(value(param, "priority"))
        out.output, out.log = value(param, "output_function/output_filename") or None, value(param, "results_logging/filename") or None
        return out
