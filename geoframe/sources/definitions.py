"""Item types, and the XML definitions of layers: made, read, and told apart."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from geoframe.kernel.gdbcodec import Header
from geoframe.types import FIELD_TYPES, GEOMETRY_TYPES, FormatError

#: Identifiers of item types and of relationships between items.
ITEM_TYPES = {
    "Folder": "{F3783E6F-65CA-4514-8315-CE3985DAD3B1}", "Workspace": "{C673FE0F-7280-404F-8532-20755DD8FC06}", "Feature Dataset": "{74737149-DCB5-4257-8904-B9724E32A530}",
    "Feature Class": "{70737809-852C-4A03-9E22-2CECEA5B9BFA}", "Table": "{CD06BC3B-789D-4C51-AAFA-A467912B8965}", "Range Domain": "{C29DA988-8C3E-45F7-8B5C-18E51EE7BEB4}",
    "Coded Value Domain": "{8C368B12-A12E-4C7E-9638-C9C64E69E98F}", "Relationship Class": "{B606A7E1-FA5B-439C-849C-6E9C2481537B}",
}
RELATIONSHIPS = {
    "DatasetInFeatureDataset": "{A1633A59-46BA-4448-8706-D8ABE2B2B02E}", "DatasetInFolder": "{DC78F1AB-34E4-43AC-BA47-1C4EABD0E7C7}",
    "DomainInDataset": "{17E08ADB-2B31-4DCD-8FDD-DF529E88F843}", "DatasetsRelatedThrough": "{725BADAB-3452-491B-A795-55F32D67229C}",
}
#: Namespaces of the definitions (the later one where a type needs it), and names of geometry types.
NAMESPACE, LATER = "http://www.esri.com/schemas/ArcGIS/10.3", "http://www.esri.com/schemas/ArcGIS/10.8"
SCHEMA = "http://www.w3.org/2001/XMLSchema-instance"
SHAPE_NAMES = {1: "esriGeometryPoint", 2: "esriGeometryMultipoint", 3: "esriGeometryPolyline", 4: "esriGeometryPolygon", 9: "esriGeometryMultiPatch"}
ROOTS = {"DEFeatureClassInfo": "feature class", "DETableInfo": "table", "DEFeatureDataset": "feature dataset", "DEWorkspace": "workspace"}


def _root(tag: str, later: bool) -> ET.Element:
    space = LATER if later else NAMESPACE
    return ET.Element(f"typens:{tag}", {"xmlns:xsi": SCHEMA, "xmlns:typens": space, "xsi:type": f"typens:{tag}"})


def _child(parent: ET.Element, tag: str, text=None, kind: str | None = None) -> ET.Element:
    out = ET.SubElement(parent, tag, {"xsi:type": kind} if kind else {})
    if text is not None:
        out.text = ("true" if text else "false") if isinstance(text, bool) else str(text)
    return out


def make(name: str, h: Header) -> str:
    """The definition of a layer, from its table's header."""
    later = any(f.type >= 13 for f in h.fields)
    root = _root("DEFeatureClassInfo" if h.grid else "DETableInfo", later)
    oid = next((f.name for f in h.fields if f.type == 6), None)
    for tag, text in (("CatalogPath", "\\" + name), ("Name", name), ("ChildrenExpanded", False), ("DatasetType", "esriDTFeatureClass" if h.grid else "esriDTTable"), ("Versioned", False), ("CanVersion", False), ("HasOID", oid is not None), ("OIDFieldName", oid or "")):
        _child(root, tag, text)
    plain = _child(_child(root, "Fields", kind="typens:Fields"), "FieldArray", kind="typens:ArrayOfField")
    infos = _child(root, "GPFieldInfoExs", kind="typens:ArrayOfGPFieldInfoEx")
    for f in h.fields:
        for parent, tag, first in ((plain, "Field", "Name"), (infos, "GPFieldInfoEx", "Name")):
            x = _child(parent, tag, kind=f"typens:{tag}")
            _child(x, first, f.name)
            if f.alias:
                _child(x, "AliasName", f.alias)
            _child(x, "Type" if tag == "Field" else "FieldType", "esriFieldType" + FIELD_TYPES[f.type][0])
            _child(x, "IsNullable", f.nullable)
            _child(x, "Length", f.length)
            _child(x, "Required", f.required)
            _child(x, "Editable", f.editable)
    if h.grid:
        shape = next(f.name for f in h.fields if f.type == 7)
        for tag, text in (("FeatureType", "esriFTSimple"), ("ShapeType", SHAPE_NAMES.get(h.geometry_type, "")), ("ShapeFieldName", shape), ("HasM", h.has_m), ("HasZ", h.has_z), ("HasSpatialIndex", False)):
            _child(root, tag, text)
        g = h.grid
        extent = _child(root, "Extent", kind="typens:EnvelopeN")
        for tag, v in zip(("XMin", "YMin", "XMax", "YMax"), g.extent):
            if v == v:
                _child(extent, tag, v)
        ref = _child(root, "SpatialReference", kind="typens:GeographicCoordinateSystem" if g.wkt.startswith("GEOGCS") else "typens:ProjectedCoordinateSystem" if g.wkt else "typens:UnknownCoordinateSystem")
        for tag, v in (("WKT", g.wkt), ("XOrigin", g.origin[0]), ("YOrigin", g.origin[1]), ("XYScale", g.scale[0]), ("ZOrigin", g.origin[2]), ("ZScale", g.scale[2]), ("MOrigin", g.origin[3]), ("MScale", g.scale[3]), ("XYTolerance", g.tolerance[0])):
            _child(ref, tag, v)
    return ET.tostring(root, encoding="unicode")


def workspace() -> str:
    root = _root("DEWorkspace", False)
    for tag, text in (("CatalogPath", "\\"), ("Name", ""), ("ChildrenExpanded", False), ("WorkspaceType", "esriLocalDatabaseWorkspace"), ("MajorVersion", 3), ("MinorVersion", 0), ("BugfixVersion", 0)):
        _child(root, tag, text)
    return ET.tostring(root, encoding="unicode")


def _tag(x: ET.Element) -> str:
    return x.tag.rpartition("}")[2].rpartition(":")[2]


def parse(text: str) -> dict:
    """Of a definition: kind, name, fields (dicts of name, type, alias, length, nullable), shape type and field, has_z, has_m, wkt, extent."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise FormatError(f"a definition that can't be read: {e}") from None
    own = {_tag(x): x for x in root}
    said = lambda tag: (own[tag].text or "") if tag in own else ""
    found = []
    block = next((own[t] for t in ("Fields", "GPFieldInfoExs") if t in own), None)
    for x in block.iter() if block is not None else ():
        if _tag(x) in ("Field", "GPFieldInfoEx"):
            v = {_tag(c): c.text or "" for c in x}
            found.append({"name": v.get("Name", ""), "type": (v.get("Type") or v.get("FieldType", "")).removeprefix("esriFieldType"), "alias": v.get("AliasName", ""), "length": int(v.get("Length") or 0), "nullable": v.get("IsNullable", "true") == "true"})
    ref = {_tag(c): c.text for c in own["SpatialReference"]} if "SpatialReference" in own else {}
    extent = {_tag(c): float(c.text) for c in own["Extent"] if c.text} if "Extent" in own else {}
    shape = said("ShapeType").removeprefix("esriGeometry").lower()
    return {"kind": ROOTS.get(_tag(root), _tag(root)), "name": said("Name"), "alias": said("AliasName"), "fields": found, "oid": said("OIDFieldName"), "shape": shape, "geometry_type": GEOMETRY_TYPES.get(shape, 0), "geometry": said("ShapeFieldName"),
            "has_z": said("HasZ") == "true", "has_m": said("HasM") == "true", "wkt": ref.get("WKT") or "", "extent": tuple(extent[k] for k in ("XMin", "YMin", "XMax", "YMax")) if len(extent) >= 4 else None}


def classify(item: dict) -> str | None:
    """What an item is: by its type's identifier, else by the root of its definition."""
    kind = (item.get("Type") or "").upper()
    for name, guid in ITEM_TYPES.items():
        if guid == kind:
            return name.lower()
    text = item.get("Definition") or ""
    return next((name for tag, name in ROOTS.items() if tag in text[:400]), None)
