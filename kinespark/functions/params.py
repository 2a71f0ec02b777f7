"""The small languages of parameters, read once on the driver into lists and maps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("Left", "Right")
#: Words that switch a map of sides off.
OFF = {"none", "off", "false", "0"}


def parts(text: str | None) -> list[str]:
    return [p.strip() for p in (text or "").split(",") if p.strip()]


def cameras(text: str | None, default: Iterable[str]) -> list[str]:
    """Names in order; null stands for the default, and a text without names is an error."""
    found = list(default) if text is None else parts(text)
    if not found:
        raise ValueError("no cameras")
    return found


def hands(text: str) -> list[str]:
    found = parts(text)
    if wrong := [h for h in found if h not in SIDES]:
        raise ValueError(f"not a hand: {wrong}")
    return found


def joint_indices(text: str, n: int = 21) -> list[int]:
    found = [int(p) for p in parts(text)]
    if wrong := [i for i in found if not 0 <= i < n]:
        raise ValueError(f"not a point: {wrong}")
    return found


def floats(text: str, default: tuple[float, ...] | None = (1.0,)) -> list[float]:
    """Numbers in order; without any the default, or an error where there is none."""
    found = [float(p) for p in parts(text)]
    if not found and default is None:
        raise ValueError("no numbers")
    return found or list(default)


def sides_by_camera(text: str | None) -> dict[str, str]:
    """"C0:Left,C3=Right" as a map; empty where switched off."""
    if not text or text.strip().lower() in OFF:
        return {}
    found = {}
    for part in parts(text):
        mark = ":" if ":" in part else "="
        camera, found_mark, side = (p.strip() for p in part.partition(mark))
        if not found_mark or side not in SIDES:
            raise ValueError(f"not camera:side: {part}")
        found[camera] = side
    return found


def cameras_by_side(text: str | None, default: dict[str, str]) -> dict[str, str]:
    """"Left:C1" over a default map."""
    found = dict(default)
    for part in parts(text):
        side, mark, camera = (p.strip() for p in part.partition(":"))
        if not mark or side not in SIDES or not camera:
            raise ValueError(f"not side:camera: {part}")
        found[side] = camera
    return found


def from_map(key: Column, table: dict[str, str]) -> Column:
    """The value of `key` in a small map; null where it has none."""
    found = F.lit(None).cast("string")
    for k, v in table.items():
        found = F.when(key == k, F.lit(v)).otherwise(found)
    return found


def dealt(names: list[str], workers: int) -> list[list[str]]:
    """names in turn over at most `workers` lists; none is empty."""
    n = max(1, min(workers, len(names)))
    return [names[i::n] for i in range(n)]


def number_tag(value: float) -> str:
    """A number for a file name: three digits, "p" for the point."""
    return f"{value:.3f}".replace(".", "p")
