"""Queries registered on the supplied tables, each with its oracle SQL where one exists."""

from importlib import import_module, util

_FAMILIES = ("manifest", "hierarchy", "voxels", "overlap", "validation", "temporal", "network", "storage")

REGISTERED: dict[str, tuple] = {}
for _name in _FAMILIES:
    if util.find_spec(f"{__name__}.{_name}"):
        REGISTERED.update(import_module(f"{__name__}.{_name}").Q)
