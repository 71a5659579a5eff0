"""V1 texts as tables of nodes, and what their structure and their region of interest say.

A typed reading passes over what it doesn't know. Here every element is a row
with its path, attributes and text, in one streaming pass over each text; the
rules are then joins with the paths that the format has, and expressions over
the few nodes of the region.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes

# Children and attributes of each element of the format; leaves have no children.
CHILDREN = {
    "Project": ["Version", "Type", "ModifiedDate", "ClassGroup", "ImageGroup", "MaskingParameter"],
    "Project.ClassGroup": ["NumberOfClasses", "Class"],
    "Project.ClassGroup.Class": ["Name", "Color"],
    "Project.ImageGroup": ["NumberOfImages", "Image"],
    "Project.ImageGroup.Image": ["Path", "Width", "Height", "SplitState", "ClassIndexOfLabel", "LabelGroup"],
    "Project.ImageGroup.Image.LabelGroup": ["IsNormal", "NumberOfLabels", "Label"],
    "Project.ImageGroup.Image.LabelGroup.Label": ["ClassIndex", "Type", "ContourGroup"],
    "Project.ImageGroup.Image.LabelGroup.Label.ContourGroup": ["Contour"],
    "Project.ImageGroup.Image.LabelGroup.Label.ContourGroup.Contour": ["Point"],
}
ATTRIBUTES = {"Project.ImageGroup.Image.LabelGroup.Label.ContourGroup.Contour": ["Type"], "Project.ImageGroup.Image.LabelGroup.Label.ContourGroup.Contour.Point": ["X", "Y"]}
MANY = ["Class", "Image", "Label", "Contour", "Point"]
# Elements below the root that are known and have no counterpart in the second generation.
UNMAPPED = ["TrainingParameter", "AugmentationParameter", "SpecificType", "OtherSettings", "MultipageParameter"]
MASK = "Project.MaskingParameter"
# Elements of the region, their attributes and the values that these have by default.
REGION = {"": {}, ".Type": {}, ".RoiRectangle": {"X": None, "Y": None, "Width": None, "Height": None, "Shape": None}, ".RoiSetting": {}, ".RoiSetting.Intensity": {"Min": 0, "Max": 255}, ".RoiSetting.Expansion": {"Value": 0}, ".RoiSetting.Inversion": {"Value": None}, ".RoiSetting.Offset": {"Left": 100, "Right": 100, "Top": 100, "Bottom": 100}, ".BlindGroup": {}, ".BlindGroup.NumberOfBlinds": {}}
# How deep elements may lie in each other.
MOST_DEPTH = 128

SCHEMA = "project_key long, path string, place string, name string, parent string, occurrence int, attributes map<string,string>, text string, n_children int, code string"


def _walk(text: str | None) -> list[tuple]:
    """(path, place, name, parent, occurrence, attributes, text, n_children, code) of each element of one text; one row with a code if it can't be read."""
    rows: list[list] = []
    open_: list[tuple[int, dict, list]] = []

    class Forbidden(ValueError):
        pass

    def start(name: str, attributes: dict) -> None:
        if len(open_) >= MOST_DEPTH:
            raise Forbidden("V1_XML_DEPTH_LIMIT_EXCEEDED")
        if open_:
            at, seen, _ = open_[-1]
            rows[at][7] += 1
            n = seen[name] = seen.get(name, -1) + 1
            above = rows[at]
            rows.append([f"{above[0]}.{name}", f"{above[1]}.{name}[{n}]", name, above[0], n, attributes, None, 0, None])
        else:
            rows.append([name, f"$.{name}", name, None, 0, attributes, None, 0, None])
        open_.append((len(rows) - 1, {}, []))

    def end(_: str) -> None:
        at, _, parts = open_.pop()
        rows[at][6] = "".join(parts).strip()

    def declared(*_) -> None:
        raise Forbidden("V1_XML_DECLARATION_FORBIDDEN")

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.StartDoctypeDeclHandler = start, end, declared
    parser.CharacterDataHandler = lambda data: open_[-1][2].append(data) if open_ else None
    try:
        parser.Parse((text or "").lstrip("﻿").encode("utf-8", "surrogatepass"), True)
    except Forbidden as error:
        return [(None, "$", None, None, 0, None, None, 0, str(error))]
    except expat.ExpatError:
        return [(None, "$", None, None, 0, None, None, 0, "V1_INVALID_XML")]
    return [tuple(r) for r in rows]


def xml_nodes(texts: DataFrame) -> DataFrame:
    """One row per element of the texts (project_key, text): path of names, place with positions, attributes, own text and number of children.

    A text that isn't well-formed, is null, or declares a document type has one
    row with a ``code`` and no path.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["project_key"], batch["text"]):
                yield pd.DataFrame([(key, *r) for r in _walk(text)], columns=names)

    return texts.select("project_key", "text").mapInPandas(read, SCHEMA)


def structure_findings(nodes: DataFrame) -> DataFrame:
    """(project_key, code, disposition, path): unreadable texts, elements and attributes that the format doesn't have, repeated and nested leaves.

    What lies below an unknown element isn't reported again; what lies in the
    masking parameter is for ``region_findings``.
    """
    known = F.array(*[F.lit(f"{p}.{c}") for p, cs in CHILDREN.items() for c in cs], F.lit("Project"))
    inner, many = F.array(*map(F.lit, CHILDREN)), F.array(*[F.lit(f"{p}.{c}") for p, cs in CHILDREN.items() for c in cs if c in MANY])
    allowed = F.create_map(*[x for p, names in ATTRIBUTES.items() for x in (F.lit(p), F.array(*map(F.lit, names)))])
    rows = nodes.withColumns({"known": F.array_contains(known, F.col("path")), "listed": F.array_contains(known, F.col("parent")) | F.col("parent").isNull()})
    masked = F.coalesce(F.col("path").startswith(MASK + "."), F.lit(False))
    extra = F.filter(F.map_keys("attributes"), lambda a: ~F.coalesce(F.array_contains(F.element_at(allowed, F.col("path")), a), F.lit(False)))
    here = F.col("known") & ~masked & (F.col("path") != MASK)
    leaf = here & ~F.array_contains(inner, F.col("path")) & ~F.col("path").endswith(".Point")
    finding = lambda df, code, disposition, path: df.select("project_key", F.lit(code).alias("code") if isinstance(code, str) else code.alias("code"), F.lit(disposition).alias("disposition"), path.alias("path"))
    broken = finding(rows.filter("code is not null"), F.col("code"), "block", F.col("place"))
    unknown = rows.filter((F.col("code").isNull()) & ~F.col("known") & F.col("listed") & ~masked)
    nodes_found = finding(unknown, F.when((F.col("parent") == "Project") & F.col("name").isin(UNMAPPED), "V1_UNMAPPED_XML_NODE").otherwise("V1_UNKNOWN_XML_NODE"), "drop", F.col("place"))
    attributes = rows.filter(here & (F.col("path") != "Project")).select("project_key", "place", F.explode(extra).alias("a"))
    attributes = finding(attributes, "V1_UNKNOWN_XML_ATTRIBUTE", "drop", F.concat("place", F.lit(".@"), "a"))
    nested = finding(rows.filter(leaf & (F.col("n_children") > 0)), "V1_LEAF_HAS_CHILDREN", "block", F.col("place"))
    twice = finding(rows.filter(F.col("known") & ~masked & ~F.array_contains(many, F.col("path")) & (F.col("occurrence") == 1)), "V1_DUPLICATE_ELEMENT", "block", F.col("place"))
    return broken.unionByName(nodes_found).unionByName(attributes).unionByName(nested).unionByName(twice)


def regions(nodes: DataFrame) -> DataFrame:
    """(project_key, roi_mode, roi_left, roi_top, roi_right, roi_bottom, findings[]) of the texts that have a masking parameter.

    ``findings`` are (code, disposition, path). Only the region's own elements
    take part, at most eleven a project; the rest of its subtree is counted
    before the projects meet.
    """
    at = lambda part: "$." + MASK + "[0]" + "".join(f".{p}[0]" for p in part.split(".") if p)
    below = nodes.filter(F.col("path").startswith(MASK) & F.col("place").startswith("$." + MASK + "[0]"))
    node = F.struct("attributes", "text", "n_children")
    pivot = [F.first(F.when(F.col("place") == at(part), node), ignorenulls=True).alias(f"n{i}") for i, part in enumerate(REGION)]
    known = F.array(*[F.lit(MASK + part) for part in REGION])
    odd = F.collect_set(F.when(~F.array_contains(known, F.col("path")) & F.array_contains(known, F.col("parent")), F.col("place")))
    again = F.collect_set(F.when(F.array_contains(known, F.col("path")) & (F.col("occurrence") == 1), F.col("place")))
    one = below.groupBy("project_key").agg(*pivot, odd.alias("odd"), again.alias("again"), F.count("*").alias("n_nodes"))
    of = {part: F.col(f"n{i}") for i, part in enumerate(REGION)}
    attribute = lambda part, name: F.nullif(F.trim(F.try_element_at(of[part]["attributes"], F.lit(name))), F.lit(""))
    value = {(part, name): codes.strict_number(attribute(part, name)) for part, names in REGION.items() for name in names if name != "Shape"}
    kind = F.lower(of[".Type"]["text"])
    noop = (kind == "not set") & (F.col("n_nodes") == 2) & (F.size(of[""]["attributes"]) == 0) & (F.size(of[".Type"]["attributes"]) == 0) & (of[""]["text"] == "")
    read = (kind == "simple") | ((kind == "not set") & ~noop)
    x, y, w, h = (value[".RoiRectangle", n] for n in ("X", "Y", "Width", "Height"))
    rectangle = F.lower(attribute(".RoiRectangle", "Shape")) == "rectangle"
    inside = (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= 1) & (y + h <= 1)
    rules: list[tuple[str, Column, str]] = [
        ("V1_REQUIRED_ELEMENT_MISSING", of[".Type"].isNull(), at(".Type")), ("V1_REQUIRED_VALUE_EMPTY", of[".Type"]["text"] == "", at(".Type")),
        ("V1_ROI_TYPE_UNSUPPORTED", (kind != "") & ~kind.isin("simple", "not set"), at(".Type")),
        *[("V1_REQUIRED_ELEMENT_MISSING", read & of[part].isNull() & (of[part.rpartition(".")[0]].isNotNull()), at(part)) for part in REGION if part not in ("", ".Type")],
        *[("V1_ROI_ELEMENT_TEXT_INVALID", read & (of[part]["text"] != ""), at(part)) for part in REGION if part not in (".Type", ".BlindGroup.NumberOfBlinds")],
        *[("V1_ROI_ATTRIBUTE_MISSING", read & of[part].isNotNull() & attribute(part, name).isNull(), f"{at(part)}.@{name}") for part, names in REGION.items() for name in names],
        *[("V1_ROI_NUMBER_INVALID", read & attribute(part, name).isNotNull() & number.isNull(), f"{at(part)}.@{name}") for (part, name), number in value.items() if part != ".RoiSetting.Inversion"],
        *[("V1_ROI_SETTING_UNSUPPORTED", read & (value[part, name] != default), f"{at(part)}.@{name}") for part, names in REGION.items() for name, default in names.items() if default is not None],
        ("V1_ROI_SETTING_INVALID", read & ~F.lower(attribute(".RoiSetting.Inversion", "Value")).isin("true", "false"), at(".RoiSetting.Inversion") + ".@Value"),
        ("V1_ROI_SETTING_UNSUPPORTED", read & (F.lower(attribute(".RoiSetting.Inversion", "Value")) == "true"), at(".RoiSetting.Inversion") + ".@Value"),
        ("V1_ROI_SHAPE_UNSUPPORTED", read & ~rectangle, at(".RoiRectangle") + ".@Shape"), ("V1_ROI_BOUNDS_INVALID", read & rectangle & ~inside, at(".RoiRectangle")),
        ("V1_ROI_BLIND_COUNT_INVALID", read & of[".BlindGroup.NumberOfBlinds"].isNotNull() & codes.strict_integer(of[".BlindGroup.NumberOfBlinds"]["text"]).isNull(), at(".BlindGroup.NumberOfBlinds")),
        ("V1_ROI_BLINDS_UNSUPPORTED", read & (codes.strict_integer(of[".BlindGroup.NumberOfBlinds"]["text"]) != 0), at(".BlindGroup.NumberOfBlinds")),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit("block").alias("disposition"), F.lit(path).alias("path"))) for code, test, path in rules]), lambda f: f.isNotNull())
    block = lambda places, code: F.transform(places, lambda p: F.struct(F.lit(code).alias("code"), F.lit("block").alias("disposition"), p.alias("path")))
    attributes = F.flatten(F.array(*[F.transform(F.coalesce(F.array_except(F.map_keys(of[part]["attributes"]), F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")), F.array().cast("array<string>")), _under(at(part))) for part, names in REGION.items()]))
    listed = F.concat(found, F.when(read, block(F.array_sort("odd"), "V1_ROI_STRUCTURE_UNSUPPORTED")).otherwise(F.array().cast("array<struct<code:string,disposition:string,path:string>>")), block(F.array_sort("again"), "V1_DUPLICATE_ELEMENT"), F.when(read, block(attributes, "V1_ROI_STRUCTURE_UNSUPPORTED")).otherwise(F.array().cast("array<struct<code:string,disposition:string,path:string>>")))
    judged = one.withColumns({"__found": listed, "__kind": kind, "__noop": F.coalesce(noop, F.lit(False)), "__x": x, "__y": y, "__r": x + w, "__b": y + h})
    clean = F.size("__found") == 0
    whole = (F.col("__x") == 0) & (F.col("__y") == 0) & (F.col("__r") == 1) & (F.col("__b") == 1)
    more = (
        F.when((F.col("__kind") == "not set") & (F.col("__noop") | (clean & whole)), _note("V1_MASKING_NOT_SET", "preserve", at("")))
        .when((F.col("__kind") == "not set") & clean, _note("V1_ROI_SETTING_UNSUPPORTED", "block", at(".RoiRectangle")))
        .when((F.col("__kind") == "simple") & clean, _note("V1_SIMPLE_RECTANGLE_ROI_MAPPED", "rebuild", at("")))
    )
    simple = (F.col("__kind") == "simple") & clean
    side = lambda c, name: F.when(simple, F.col(c)).alias(name)
    return judged.select(
        "project_key", F.when(F.col("__kind") == "not set", "none").when(F.col("__kind") == "simple", "simple").when(F.col("__kind") != "", "other").alias("roi_mode"),
        side("__x", "roi_left"), side("__y", "roi_top"), side("__r", "roi_right"), side("__b", "roi_bottom"), F.when(more.isNull(), F.col("__found")).otherwise(F.concat("__found", F.array(more))).alias("findings"),
    )


def _under(place: str):
    return lambda a: F.concat(F.lit(place + ".@"), a)


def _note(code: str, disposition: str, path: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(disposition).alias("disposition"), F.lit(path).alias("path"))


def region_findings(nodes: DataFrame) -> DataFrame:
    """(project_key, code, disposition, path): what stands against the regions of interest, and what becomes of them."""
    return regions(nodes).select("project_key", F.explode("findings").alias("f")).select("project_key", "f.*")
