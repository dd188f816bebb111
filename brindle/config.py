"""Index configuration: YAML with tagged field types, field names, and the flat list of columns."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

DYNAMIC = "_dynamic"
TOKENIZERS = ("default", "raw", "en_stem", "whitespace")
FORMATS = ("rfc3339", "timestamp", "iso8601", "rfc2822")
#: Type tags with the options that each takes and their defaults.
OPTIONS: dict[str, dict[str, Any]] = {
    "text": {"stored": True, "fast": False, "indexed": True},
    "number": {"type": None, "stored": True, "fast": False, "indexed": True, "parse_string": True},
    "boolean": {"stored": True, "fast": False, "indexed": True, "parse_string": True},
    "datetime": {"stored": True, "fast": False, "indexed": True, "formats": ["rfc3339", "timestamp"]},
    "ip": {"stored": True, "fast": False, "indexed": True},
    "dynamic_object": {"stored": True, "fast": True, "indexed": True, "expand_dots": True},
    "static_object": {"fields": []},
}
#: What an ``indexed`` with a body can hold, by kind.
INDEXED = {"text": {"record", "fieldnorms", "tokenizer"}, "dynamic_object": {"record", "tokenizer"}}
#: How much is kept of a term: that it is there, how often, where. Without ``record`` everything is.
RECORDS = ("basic", "freq", "position")


class ConfigError(ValueError):
    """The configuration can't be used."""


def escape_name(name: str) -> str:
    """A field name with its literal dots escaped."""
    return name.replace(".", "\\.")


def split_name(path: str) -> list[str]:
    """The parts of a dotted path; ``\\.`` is a literal dot."""
    parts, part, at = [], "", 0
    while at < len(path):
        if path[at] == "\\" and at + 1 < len(path):
            part += path[at + 1]
            at += 1
        elif path[at] == ".":
            parts.append(part)
            part = ""
        else:
            part += path[at]
        at += 1
    return [*parts, part]


@dataclass(frozen=True)
class Field:
    """One declared field. ``path`` holds the names from the top."""

    path: tuple[str, ...]
    kind: str
    options: dict[str, Any] = field(default_factory=dict, hash=False)
    array: bool = False
    fields: tuple[Field, ...] = ()

    @property
    def name(self) -> str:
        """The dotted, escaped name, which is also the column's."""
        return ".".join(map(escape_name, self.path))

    @property
    def indexed(self) -> bool:
        return self.kind != "static_object" and self.options["indexed"] is not False

    @property
    def stored(self) -> bool:
        return bool(self.options.get("stored", True))

    @property
    def tokenizer(self) -> str:
        indexed = self.options.get("indexed")
        if isinstance(indexed, dict):
            return indexed.get("tokenizer") or ("raw" if self.kind == "dynamic_object" else "default")
        return "default"

    def _detail(self, name: str, default: Any) -> Any:
        indexed = self.options.get("indexed")
        return indexed.get(name, default) if isinstance(indexed, dict) else default

    @property
    def frequencies(self) -> bool:
        """Whether a term counts as often as it is there; if not, once."""
        return self._detail("record", "position") != "basic"

    @property
    def positions(self) -> bool:
        """Whether phrases can be searched for."""
        return self._detail("record", "position") == "position"

    @property
    def fieldnorms(self) -> bool:
        """Whether a term counts for more in a short text."""
        return bool(self._detail("fieldnorms", True))

    def leaves(self) -> list[Field]:
        """This field, or those inside it."""
        return [leaf for f in self.fields for leaf in f.leaves()] if self.kind == "static_object" else [self]


@dataclass(frozen=True)
class IndexConfig:
    name: str
    path: str
    fields: tuple[Field, ...]
    version: int = 1
    time_field: str | None = None

    def leaves(self) -> list[Field]:
        return [leaf for f in self.fields for leaf in f.leaves()]

    def default_fields(self) -> list[Field]:
        """What a query without a field searches, and what results show."""
        return [f for f in self.leaves() if f.indexed]


def _field(raw: dict, above: tuple[str, ...]) -> Field:
    tag = raw.get("type")
    kind, given = (tag["tag"], tag["body"] or {}) if isinstance(tag, dict) and "tag" in tag else (tag, {})
    if kind not in OPTIONS:
        raise ConfigError(f"field {raw.get('name')!r} has no known type: {kind!r}")
    if unknown := given.keys() - OPTIONS[kind].keys():
        raise ConfigError(f"field {raw['name']!r}: {kind} has no option {sorted(unknown)}")
    options = {**OPTIONS[kind], **given}
    if isinstance(options.get("indexed"), dict) and "tag" in options["indexed"]:
        options["indexed"] = options["indexed"]["body"] or {}
    if isinstance(options.get("indexed"), dict):
        inside = options["indexed"]
        if unknown := inside.keys() - INDEXED.get(kind, set()):
            raise ConfigError(f"field {raw['name']!r}: indexed of {kind} has no option {sorted(unknown)}")
        if inside.get("record", "position") not in RECORDS:
            raise ConfigError(f"field {raw['name']!r}: records are {RECORDS}")
        if not isinstance(inside.get("fieldnorms", True), bool):
            raise ConfigError(f"field {raw['name']!r}: fieldnorms is true or false")
    path = (*above, raw["name"])
    array = bool(raw.get("array", False))
    if kind == "static_object" and array:
        raise ConfigError(f"field {raw['name']!r}: an array of static objects isn't supported")
    if kind == "number" and options["type"] not in ("u64", "i64", "f64"):
        raise ConfigError(f"field {raw['name']!r}: number needs the type u64, i64 or f64")
    if kind == "datetime" and set(options["formats"]) - set(FORMATS):
        raise ConfigError(f"field {raw['name']!r}: formats are {FORMATS}")
    inner = tuple(_field(f, path) for f in options.pop("fields", []))
    made = Field(path, kind, options, array, inner)
    if kind in ("text", "dynamic_object") and made.tokenizer not in TOKENIZERS:
        raise ConfigError(f"field {raw['name']!r}: tokenizers are {TOKENIZERS}")
    return made


def from_dict(raw: dict) -> IndexConfig:
    schema = raw["schema"]
    fields = tuple(_field(f, ()) for f in schema.get("fields") or [])
    names = [f.path[0] for f in fields]
    if len(set(names)) < len(names) or DYNAMIC in names:
        raise ConfigError(f"field names must differ, also from {DYNAMIC}")
    return IndexConfig(raw["name"], raw["path"], fields, raw.get("version", 1), schema.get("time_field"))


def read_yaml(text: str) -> dict:
    """YAML as plain values; a tagged one becomes {"tag", "body"}, and a tag without a body has None."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def tagged(loader: Any, suffix: str, node: Any) -> dict:
        if isinstance(node, yaml.MappingNode):
            body = loader.construct_mapping(node, deep=True)
        elif isinstance(node, yaml.SequenceNode):
            body = loader.construct_sequence(node, deep=True)
        else:
            body = loader.construct_scalar(node) or None
        return {"tag": suffix, "body": body}

    Loader.add_multi_constructor("!", tagged)
    return yaml.load(text, Loader)


def load(text: str) -> tuple[IndexConfig, str]:
    """The configuration in a YAML text, and the same as JSON for the catalog."""
    raw = read_yaml(text)
    return from_dict(raw), json.dumps(raw)
