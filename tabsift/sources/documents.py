"""YAML, XML and JSON documents that need a Python parser, as Arrow-batched UDFs."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain(value):
    """A parsed YAML value as JSON can hold it: text keys, no infinities, dates as text."""
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_plain(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return str(value)
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    return str(value)


#: Entries of a long list that are loaded at once.
YAML_ENTRIES = 1000
_ENTRY_START = re.compile(r"^-(?=[ \n\r])", re.M)
_DOCUMENT_MARK = re.compile(r"^(?:---|\.\.\.|%)", re.M)


def _dumped(value) -> str:
    return json.dumps(_plain(value), ensure_ascii=False)


def _yaml_parts(source: str) -> Iterator[str]:
    """A long block list as lists of some of its entries; any other text as it is."""
    if not _ENTRY_START.match(source) or _DOCUMENT_MARK.search(source):
        yield source
        return
    start = 0
    for i, m in enumerate(_ENTRY_START.finditer(source)):
        if i and i % YAML_ENTRIES == 0:
            yield source[start:m.start()]
            start = m.start()
    yield source[start:]


def yaml_document(source: str, loader) -> str:
    """A YAML document as JSON text. A loaded document takes many times its text, so a long list is loaded
    by some entries at a time. A part that ends within a quoted text or refers to another part does not
    parse by itself; then the document is loaded whole."""
    import yaml

    dumped = []
    try:
        for part in _yaml_parts(source):
            doc = yaml.load(part, Loader=loader)
            if len(part) == len(source):
                return _dumped({} if doc is None else doc)
            dumped.append(_dumped(doc)[1:-1])
        return f"[{', '.join(dumped)}]"
    except yaml.YAMLError:
        if len(part) == len(source):
            raise
    return _dumped(yaml.load(source, Loader=loader))


def yaml_to_json(text: Column) -> Column:
    """One YAML document per value as JSON text; null where it does not parse, ``{}`` if empty."""

    @F.pandas_udf("string")
    def convert(batch: pd.Series) -> pd.Series:
        import yaml

        # The C parser where the library has it: same documents, many times faster.
        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

        def one(source):
            if source is None:
                return None
            try:
                return yaml_document(source, loader)
            except yaml.YAMLError:
                return None

        return batch.map(one, na_action="ignore")

    return convert(text)


def _element(e: ET.Element):
    """An element as a JSON value: attributes, own text, then children; repeats become arrays."""
    out = {f"@{k}": v for k, v in e.attrib.items()}
    text = (e.text or "").strip()
    if text and (out or len(e)):
        out = {**out, "#text": text}
    for child in e:
        value = _element(child)
        if child.tag not in out:
            out[child.tag] = value
        elif isinstance(out[child.tag], list):
            out[child.tag].append(value)
        else:
            out[child.tag] = [out[child.tag], value]
    return out or text or None


def xml_to_json(text: Column) -> Column:
    """One XML document per value as JSON text: strings and nulls only, nothing inferred.

    Null where it is not well-formed; documents that define entities are refused.
    """

    @F.pandas_udf("string")
    def convert(batch: pd.Series) -> pd.Series:
        def one(source):
            if source is None or "<!ENTITY" in source:
                return None
            try:
                return json.dumps(_element(ET.fromstring(source)), ensure_ascii=False)
            except (ET.ParseError, ValueError):
                return None

        return batch.map(one, na_action="ignore")

    return convert(text)


def json_to_yaml(text: Column, as_item: bool = False) -> Column:
    """JSON text as block-style YAML, key order kept; ``as_item`` makes it one list entry."""

    @F.pandas_udf("string")
    def convert(batch: pd.Series) -> pd.Series:
        import yaml

        dumper = getattr(yaml, "CSafeDumper", yaml.SafeDumper)

        def one(source):
            value = json.loads(source)
            return yaml.dump(
                [value] if as_item else value, Dumper=dumper,
                sort_keys=False, allow_unicode=True, default_flow_style=False,
            ).rstrip("\n")

        return batch.map(one, na_action="ignore")

    return convert(text)
