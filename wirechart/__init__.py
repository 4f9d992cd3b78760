"""Service architecture analytics and training-data operators on Spark. The public names are those of ``__all__``, loaded on first use."""

import importlib

_PLACES = {
    "scan": "wirechart.scanning",
    "extract": "wirechart.scanning",
    "connect": "wirechart.scanning",
    "save_scan": "wirechart.scanning",
    "save_documents": "wirechart.sources.saved",
    "read_documents": "wirechart.sources.saved",
    "source_files": "wirechart.sources.files",
    "source_names": "wirechart.sources.files",
    "service_roots": "wirechart.sources.files",
    "detect": "wirechart.operators.detect",
    "endpoints": "wirechart.operators.endpoints",
    "outbound_calls": "wirechart.operators.calls",
    "payload_types": "wirechart.operators.facts",
    "url_hints": "wirechart.operators.facts",
    "messages": "wirechart.operators.usage",
    "stores": "wirechart.operators.usage",
    "shared_libraries": "wirechart.operators.usage",
    "resolve": "wirechart.operators.resolve",
    "call_chains": "wirechart.operators.resolve",
    "openapi_specs": "wirechart.operators.interfaces",
    "spec_dependencies": "wirechart.operators.interfaces",
    "insights": "wirechart.operators.graph",
    "diff_documents": "wirechart.operators.reports",
    "document": "wirechart.operators.reports",
    "export": "wirechart.operators.reports",
    "watch": "wirechart.streaming.watch",
    "changed_files": "wirechart.streaming.watch",
    "refresh": "wirechart.streaming.refresh",
    "rescanner": "wirechart.streaming.refresh",
    "Plugin": "wirechart.plugins",
    "registry": "wirechart.plugins",
}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    """A public name from its module; modules of the package keep their own names."""
    if name not in _PLACES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(_PLACES[name]), name)
