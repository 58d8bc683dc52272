"""Schemas and shapes of the data model."""

from __future__ import annotations

from arborlake.operators.nested import Shape

ENTRY = Shape("entries", {"language": "string", "files": "bigint", "lines": "bigint", "percentage": "double"}, key="language")
SCOPE = Shape("scopes", {"languageStats.totalFiles": "bigint", "languageStats.totalLines": "bigint"}, repeated={"languageStats.perLanguage": (ENTRY, "language")}, text=frozenset({"languageStats"}))
COMPONENT = Shape(
    "components",
    {"path": "string", "name": "string", "kind": "string", "description": "string"},
    single={"scoped": SCOPE},
    key="path",
    text=frozenset({"scoped"}),
    recursive=("components", "path"),
)
RESULT = Shape(
    "results",
    {"rootPath": "string", "scannedAt": "string", "architecture.monorepo": "boolean", "architecture.toolName": "string", "languageStats.totalFiles": "bigint", "languageStats.totalLines": "bigint"},
    repeated={"architecture.components": (COMPONENT, "path"), "languageStats.perLanguage": (ENTRY, "language")},
    key="rootPath",
    anywhere=frozenset({"rootPath", "scannedAt", "inventory", "architecture", "languageStats"}),
)
