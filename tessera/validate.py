"""Checks of arguments at the API's edge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

CONFIG_SUFFIXES = (".yaml", ".yml", ".json", ".toml")


def check_type(value, expected, name: str) -> None:
    if not isinstance(value, expected) or (isinstance(value, bool) and expected in (int, float, (int, float))):
        names = " or ".join(t.__name__ for t in expected) if isinstance(expected, tuple) else expected.__name__
        raise TypeError(f"{name} must be {names}, not {type(value).__name__}")


def check_unit(value: float, name: str) -> None:
    check_type(value, (int, float), name)
    if not 0 <= value <= 1:
        raise ValueError(f"{name} must be between 0 and 1")


def partition_ratios(ratios: Sequence[float]) -> tuple[float, ...]:
    """One train share, two that leave a rest for testing, or three that sum to 1."""
    if not 1 <= len(ratios) <= 3:
        raise ValueError("one to three ratios")
    for r in ratios:
        check_type(r, float, "ratio")
        if r < 0:
            raise ValueError("ratios must not be negative")
    total = sum(ratios)
    if len(ratios) == 1 and not 0.5 <= total <= 0.95:
        raise ValueError("a single ratio must be between 0.5 and 0.95")
    if len(ratios) == 2 and not 0.525 <= total <= 0.975:
        raise ValueError("two ratios must sum to between 0.525 and 0.975")
    if len(ratios) == 3 and abs(total - 1) > 1e-6:
        raise ValueError("three ratios must sum to 1")
    return tuple(ratios)


def split_ratios(ratios: Sequence[float]) -> tuple[float, ...]:
    if len(ratios) < 2 or abs(sum(ratios) - 1) > 1e-4 or min(ratios) < 0:
        raise ValueError("two or more ratios that sum to 1")
    return tuple(float(r) for r in ratios)


def split_mode(by_class: bool, ratios: Sequence[float] | None, class_groups: Sequence | None) -> None:
    """At least one way to split; groups are lists with classes in them."""
    check_type(by_class, bool, "by_class")
    if class_groups is not None:
        check_type(class_groups, (list, tuple), "class_groups")
        if not class_groups or not all(isinstance(g, (list, tuple)) and g and all(isinstance(c, str) for c in g) for g in class_groups):
            raise ValueError("class_groups are lists of class names")
    elif not by_class:
        if ratios is None:
            raise ValueError("split by classes, groups or ratios")
        split_ratios(ratios)


def class_map(mapping: Mapping, names: Sequence[str]) -> dict[int, int | str]:
    """Keys as ids; unknown names, ids out of range and other types raise."""
    check_type(mapping, Mapping, "class_map")
    if not mapping:
        raise ValueError("class_map is empty")
    out: dict[int, int | str] = {}
    for key, value in mapping.items():
        if isinstance(key, str):
            if key not in names:
                raise ValueError(f"unknown class: {key}")
            key = list(names).index(key)
        elif not isinstance(key, int) or isinstance(key, bool):
            raise TypeError("class keys are names or ids")
        if not 0 <= key < len(names):
            raise ValueError(f"class id out of range: {key}")
        if isinstance(value, bool) or not isinstance(value, (int, str)):
            raise TypeError("class values are names or ids")
        if isinstance(value, int) and value < 0:
            raise ValueError("class ids must not be negative")
        out[key] = value
    return out


def detection_options(box_threshold: float = 0.25, text_threshold: float = 0.25, max_area: float = 1.0, color: Sequence[int] = (0, 255, 0), thickness: int = 2, font_scale: float = 0.5) -> None:
    for value, name in ((box_threshold, "box_threshold"), (text_threshold, "text_threshold"), (max_area, "max_area")):
        check_unit(value, name)
    if len(color) != 3 or not all(isinstance(c, int) and 0 <= c <= 255 for c in color):
        raise ValueError("color is three numbers from 0 to 255")
    if thickness <= 0 or font_scale <= 0:
        raise ValueError("thickness and font_scale must be positive")


def config_suffix(path: str) -> str:
    check_type(path, str, "path")
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in CONFIG_SUFFIXES:
        raise ValueError(f"unsupported suffix: {suffix}")
    return suffix


def archive_path(path: str) -> str:
    check_type(path, str, "path")
    if PurePosixPath(path).suffix.lower() != ".zip":
        raise ValueError("archives end in .zip")
    return path


def merge_sources(sources: Sequence[str], least: int = 2) -> list[str]:
    check_type(sources, (list, tuple), "sources")
    if len(sources) < least:
        raise ValueError(f"at least {least} sources")
    return list(sources)
