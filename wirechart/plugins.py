"""Plugins: a caller's own language, found by a condition on files and read by a function of DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class Plugin:
    """can_handle: a condition on a file of the service's root. parse: files(service, path, content) to endpoints.

    framework and confidence are what detection reports for services of this plugin.
    """

    name: str
    language: str
    can_handle: Callable[[], Column]
    parse: Callable[[DataFrame], DataFrame]
    framework: str = "unknown"
    confidence: float = 0.5


class Registry:
    """Plugins in the order in which they were registered; a name counts once, the last registration replacing the first."""

    def __init__(self) -> None:
        self._own: dict[str, Plugin] = {}

    def register(self, plugin: Plugin) -> None:
        self._own[plugin.name] = plugin

    def unregister(self, name: str) -> None:
        self._own.pop(name, None)

    def __iter__(self):
        return iter(self._own.values())

    def rules(self) -> list[tuple]:
        """For ``detect``: what a plugin can handle counts after the built-in rules."""
        return [(p.can_handle, p.language, p.framework, p.confidence) for p in self]

    def endpoints(self, files: DataFrame, detected: DataFrame) -> DataFrame | None:
        """Endpoints of the services whose language is a plugin's; None without plugins."""
        out = None
        for p in self:
            own = p.parse(files.join(detected.where(detected["language"] == p.language).select("service"), "service", "left_semi"))
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
        return out


registry = Registry()
