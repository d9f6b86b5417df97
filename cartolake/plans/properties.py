"""Trees of named nodes with typed properties, as XML or JSON: how workspaces, maps and their parts are described in files."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any
from xml.etree import ElementTree

_READ = {"bool": lambda s: s == "true", "int": int, "float": float, "str": str, "bytes": base64.b64decode, "none": lambda _: None}
_WRITE = {"bool": lambda v: str(v).lower(), "int": str, "float": repr, "str": str, "bytes": lambda v: base64.b64encode(v).decode(), "none": lambda _: ""}


def _kind(value: Any) -> str:
    return "none" if value is None else type(value).__name__


@dataclass
class Node:
    name: str
    properties: dict[str, Any] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)

    def add(self, name: str, **properties: Any) -> Node:
        self.children.append(Node(name, properties))
        return self.children[-1]

    def get(self, name: str, default: Any = None) -> Any:
        return self.properties.get(name, default)

    def child(self, name: str) -> Node | None:
        return next(self.named(name), None)

    def named(self, name: str) -> Iterator[Node]:
        return (c for c in self.children if c.name == name)

    def remove(self, name: str) -> None:
        self.children = [c for c in self.children if c.name != name]

    def _element(self) -> ElementTree.Element:
        e = ElementTree.Element("node", name=self.name)
        for name, value in self.properties.items():
            if (kind := _kind(value)) not in _WRITE:
                raise ValueError(f"a property can't be of type {kind}")
            ElementTree.SubElement(e, "property", name=name, type=kind).text = _WRITE[kind](value)
        e.extend(c._element() for c in self.children)
        return e

    @staticmethod
    def _of(e: ElementTree.Element) -> Node:
        return Node(e.get("name", ""), {p.get("name"): _READ[p.get("type")](p.text or "") for p in e.findall("property")}, [Node._of(c) for c in e.findall("node")])

    def to_xml(self) -> str:
        return ElementTree.tostring(self._element(), encoding="unicode")

    @staticmethod
    def from_xml(text: str) -> Node:
        return Node._of(ElementTree.fromstring(text))

    def to_json(self) -> str:
        plain = lambda n: {"name": n.name, "properties": {k: {"type": _kind(v), "value": _WRITE[_kind(v)](v)} for k, v in n.properties.items()}, "children": [plain(c) for c in n.children]}
        return json.dumps(plain(self))

    @staticmethod
    def from_json(text: str) -> Node:
        tree = lambda d: Node(d["name"], {k: _READ[v["type"]](v["value"]) for k, v in d["properties"].items()}, [tree(c) for c in d["children"]])
        return tree(json.loads(text))
