"""Carries out plans on a file system that all executors share, one outcome per row.

Tasks may run twice, so every step can: a file that is gone while its destination is there counts as done. Nothing happens
in a dry run. Links and moves never overwrite a file unless the plan says so."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterator
from datetime import datetime
from functools import partial
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels
from ..storage import written

_OUTCOME = "op string, src string, dest string, reason string, status string, file_size long, error string"


def _move(src: str, dest: str, reason: str | None) -> None:
    if src == dest or not os.path.lexists(src) and os.path.lexists(dest):
        return
    if os.path.lexists(dest) and reason != "overwrites":
        raise FileExistsError(dest)
    os.makedirs(os.path.dirname(dest), exist_ok=True)
    shutil.move(src, dest)


def _copy(src: str, dest: str, reason: str | None) -> None:
    os.makedirs(os.path.dirname(dest), exist_ok=True)
    draft = f"{dest}.part-{os.getpid()}"
    shutil.copy2(src, draft)
    os.replace(draft, dest)


def _delete(src: str, dest: str, reason: str | None) -> None:
    if os.path.lexists(src):
        os.remove(src)


def _link(make: Callable[[str, str], None]) -> Callable[[str, str, str | None], None]:
    def run(src: str, dest: str, reason: str | None) -> None:
        if not os.path.exists(dest):
            raise FileNotFoundError(dest)
        draft = f"{src}.part-{os.getpid()}"
        make(dest, draft)
        os.replace(draft, src)

    return run


def _convert(src: str, dest: str, reason: str | None, quality: int = 95) -> None:
    if not os.path.exists(src) and os.path.exists(dest):
        return
    data = pixels.encode_jpeg(pixels.pixels(Path(src).read_bytes()), quality)
    draft = f"{dest}.part-{os.getpid()}"
    Path(draft).write_bytes(data)
    os.replace(draft, dest)
    if reason == "deletes the original":
        os.remove(src)


ACTIONS: dict[str, Callable[[str, str, str | None], None]] = {
    "move": _move,
    "rename": _move,
    "copy": _copy,
    "delete": _delete,
    "hardlink": _link(os.link),
    "symlink": _link(lambda dest, draft: os.symlink(os.path.relpath(dest, os.path.dirname(draft)), draft)),
    "convert": _convert,
}


def execute(plan: DataFrame, dry_run: bool = True, quality: int = 95) -> DataFrame:
    """plan with status done, error, skipped or (in a dry run) planned, the file's size and the error's text. quality: of
    converted pictures."""
    actions = ACTIONS | {"convert": partial(_convert, quality=quality)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for op, src, dest, reason, status in batch.itertuples(index=False):
                size, error = None, None
                try:
                    size = os.stat(src).st_size
                except OSError:
                    pass
                if status == "planned" and not dry_run:
                    try:
                        actions[op](src, dest, reason)
                        status = "done"
                    except (OSError, KeyError, pixels.Unreadable) as e:
                        status, error = "error", f"{type(e).__name__}: {e}"
                out.append((op, src, dest, reason, status, size, error))
            yield pd.DataFrame(out, columns=["op", "src", "dest", "reason", "status", "file_size", "error"]).astype({"file_size": "Int64"})

    rows = plan.select("op", "src", "dest", "reason", "status")
    return written(rows.mapInPandas(run, _OUTCOME), "outcomes")


def remove_folders(plan: DataFrame, dry_run: bool = True) -> DataFrame:
    """Outcome of plans of empty_folders(), level by level, the deepest first; a folder that isn't empty by now stays."""
    rows = written(plan, "folders")
    depths = sorted((r[0] for r in rows.select("depth").distinct().collect()), reverse=True)
    out = None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for src in batch["src"]:
                status, error = "planned", None
                if not dry_run:
                    try:
                        if os.path.isdir(src):
                            os.rmdir(src)
                        status = "done"
                    except OSError as e:
                        status, error = "error", str(e)
                found.append(("rmdir", src, None, None, status, None, error))
            yield pd.DataFrame(found, columns=["op", "src", "dest", "reason", "status", "file_size", "error"]).astype({"file_size": "Int64"})

    for depth in depths:
        level = written(rows.filter(F.col("depth") == depth).select("src").mapInPandas(run, _OUTCOME), "outcomes")
        out = level if out is None else out.unionByName(level)
    return rows.sparkSession.createDataFrame([], _OUTCOME) if out is None else out


def set_times(rows: DataFrame, dry_run: bool = True) -> DataFrame:
    """rows: path, new_time. Access and modification times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, at in zip(batch["path"], batch["at"]):
                status, error = "planned", None
                if not dry_run:
                    try:
                        os.utime(path, (at, at))
                        status = "done"
                    except OSError as e:
                        status, error = "error", str(e)
                out.append((path, status, error))
            yield pd.DataFrame(out, columns=["path", "status", "error"])

    return written(rows.select("path", F.unix_timestamp("new_time").cast("double").alias("at")).mapInPandas(run, "path string, status string, error string"), "outcomes")


def exif_segment(text: str) -> bytes:
    """A JPEG APP1 segment with the three date tags; text: YYYY:MM:DD HH:MM:SS."""
    value = text.encode("ascii") + b"\0"

    def directory(entries: list[tuple[int, int, int, int]]) -> bytes:
        body = b"".join(tag.to_bytes(2, "big") + kind.to_bytes(2, "big") + n.to_bytes(4, "big") + at.to_bytes(4, "big") for tag, kind, n, at in entries)
        return len(entries).to_bytes(2, "big") + body + bytes(4)

    # Tags DateTime 0x132, ExifIFD 0x8769, DateTimeOriginal 0x9003, DateTimeDigitized 0x9004; kinds ASCII 2, LONG 4.
    first, second = 8, 8 + 2 + 24 + 4
    texts = second + 2 + 24 + 4
    tiff = b"MM\0*" + first.to_bytes(4, "big")
    tiff += directory([(0x132, 2, 20, texts), (0x8769, 4, 1, second)])
    tiff += directory([(0x9003, 2, 20, texts + 20), (0x9004, 2, 20, texts + 40)]) + value * 3
    body = b"Exif\0\0" + tiff
    return b"\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body


def _entries(tiff: bytes, at: int) -> tuple[list[bytes], int]:
    """Entries (12 bytes each) of a TIFF directory, and the place of the next one."""
    order = "little" if tiff[:2] == b"II" else "big"
    n = int.from_bytes(tiff[at : at + 2], order)
    end = at + 2 + 12 * n
    if end + 4 > len(tiff):
        raise pixels.Unreadable("TIFF directory is cut", "bad_exif")
    return [tiff[at + 2 + 12 * i : at + 14 + 12 * i] for i in range(n)], int.from_bytes(tiff[end : end + 4], order)


def dated_tiff(tiff: bytes, text: str) -> bytes:
    """A TIFF (or the EXIF data of a JPEG) with the three date tags; all other data stays where it is. Tags that are there are
    written over; for others both directories are written anew at the end."""
    order = "little" if tiff[:2] == b"II" else "big"
    value = text.encode("ascii") + b"\0"
    number = lambda b: int.from_bytes(b, order)
    as_bytes = lambda x, n: x.to_bytes(n, order)
    first, following = _entries(tiff, number(tiff[4:8]))
    pointer = next((number(e[8:12]) for e in first if number(e[:2]) == 0x8769), None)
    second = _entries(tiff, pointer)[0] if pointer else []
    found = [e for e in (*first, *second) if number(e[:2]) in (0x132, 0x9003, 0x9004) and number(e[4:8]) == len(value)]
    if len(found) == 3 and all(number(e[8:12]) + len(value) <= len(tiff) for e in found):
        out = bytearray(tiff)
        for e in found:
            out[number(e[8:12]) : number(e[8:12]) + len(value)] = value
        return bytes(out)

    def directory(entries: list[bytes], then: int) -> bytes:
        entries = sorted(entries, key=lambda e: number(e[:2]))
        return as_bytes(len(entries), 2) + b"".join(entries) + as_bytes(then, 4)

    own = lambda tag, kind, n, at: as_bytes(tag, 2) + as_bytes(kind, 2) + as_bytes(n, 4) + as_bytes(at, 4)
    tiff += bytes(len(tiff) % 2)
    texts = len(tiff)
    inner_at = texts + 3 * len(value)
    inner = directory([e for e in second if number(e[:2]) not in (0x9003, 0x9004)] + [own(0x9003, 2, len(value), texts + len(value)), own(0x9004, 2, len(value), texts + 2 * len(value))], 0)
    outer = directory([e for e in first if number(e[:2]) not in (0x132, 0x8769)] + [own(0x132, 2, len(value), texts), own(0x8769, 4, 1, inner_at)], following)
    return tiff[:4] + as_bytes(inner_at + len(inner), 4) + tiff[8:] + value * 3 + inner + outer


def _exif_of(data: bytes) -> bytes | None:
    """The EXIF data of a JPEG, a TIFF of its own."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        at += 2 + size
    return None


def with_exif_dates(data: bytes, text: str) -> bytes:
    """A JPEG or TIFF with the three date tags; its other EXIF data is kept. EXIF data that is broken, or beyond the length of
    a segment then, is replaced."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return dated_tiff(data, text)
    if data[:2] != b"\xff\xd8":
        raise pixels.Unreadable("EXIF dates are written to JPEG and TIFF files only", "invalid_format")
    plain, segment, known = without_exif(data), exif_segment(text), _exif_of(data)
    if known is not None:
        try:
            body = b"Exif\0\0" + dated_tiff(known, text)
            if len(body) + 2 <= 0xFFFF:
                segment = b"\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body
        except (pixels.Unreadable, OverflowError):
            pass  # the new segment takes its place
    return plain[:2] + segment + plain[2:]


def without_exif(data: bytes) -> bytes:
    """A JPEG without EXIF segments; the same object if there is none."""
    at, kept, found = 2, [data[:2]], False
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 8] == b"Exif":
            found = True
        else:
            kept.append(data[at : at + size])
        at += size
    return b"".join([*kept, data[at:]]) if found else data


def exif_dates(data: bytes) -> dict[int, str]:
    """Date tags of a TIFF, or of a JPEG's EXIF data, by tag."""
    found = data if data[:4] in (b"II*\0", b"MM\0*") else _exif_of(data)
    return _dates(found) if found else {}


def _dates(tiff: bytes) -> dict[int, str]:
    order = "little" if tiff[:2] == b"II" else "big"
    number = lambda a, n: int.from_bytes(tiff[a : a + n], order)
    out, left = {}, [number(4, 4)]
    while left:
        start = left.pop()
        for i in range(number(start, 2)):
            e = start + 2 + 12 * i
            tag, n, value = number(e, 2), number(e + 4, 4), number(e + 8, 4)
            if tag == 0x8769:
                left.append(value)
            elif tag in (0x132, 0x9003, 0x9004):
                out[tag] = tiff[value : value + n].rstrip(b"\0").decode("ascii", "replace")
    return out


def set_exif_dates(rows: DataFrame, dry_run: bool = True) -> DataFrame:
    """rows: path, exif_time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["exif_time"]):
                status, error = "planned", None
                if not dry_run:
                    try:
                        data = with_exif_dates(Path(path).read_bytes(), text)
                        draft = f"{path}.part-{os.getpid()}"
                        Path(draft).write_bytes(data)
                        os.replace(draft, path)
                        status = "done"
                    except (OSError, pixels.Unreadable) as e:
                        status, error = "error", str(e)
                out.append((path, status, error))
            yield pd.DataFrame(out, columns=["path", "status", "error"])

    return written(rows.select("path", "exif_time").mapInPandas(run, "path string, status string, error string"), "outcomes")


_REPAIR = "path string, readable boolean, writable boolean, parent_writable boolean, corruption_type string, repaired boolean, repair_attempts array<string>, error string"


def inspect(files: DataFrame, repair: bool = False) -> DataFrame:
    """files: path. Permissions and damage of each file, and whether a repair works: the pixels that are left of a PNG, the
    file without its EXIF data, the pixels written again. Only with repair are files changed."""

    def tried(path: str, kind: str) -> tuple[bool, list[str]]:
        data = Path(path).read_bytes()
        attempts = []
        for name, change in (("partial", pixels.salvaged), ("strip-exif", without_exif), ("raw-pixels", lambda d: d)):
            attempts.append(name)
            try:
                good = change(data)
                image = pixels.pixels(good)
            except pixels.Unreadable:
                continue
            if repair:
                draft = f"{path}.part-{os.getpid()}"
                Path(draft).write_bytes(good if good is not data else pixels.encode_png(image))
                os.replace(draft, path)
            return True, attempts
        return False, attempts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                may = [os.access(path, os.R_OK), os.access(path, os.W_OK), os.access(os.path.dirname(path), os.W_OK)]
                kind, error, repaired, attempts = "permission_denied", None, False, []
                if may[0]:
                    try:
                        kind = "none"
                        pixels.pixels(Path(path).read_bytes())
                    except pixels.Unreadable as e:
                        kind, error = ("none" if e.kind == "no_decoder" else e.kind), str(e)
                    except OSError as e:
                        kind, error = "unknown", str(e)
                    if kind not in ("none", "invalid_format"):
                        repaired, attempts = tried(path, kind)
                else:
                    error = "File is not readable"
                out.append((path, *may, kind, repaired, attempts, error))
            yield pd.DataFrame(out, columns=["path", "readable", "writable", "parent_writable", "corruption_type", "repaired", "repair_attempts", "error"])

    return written(files.select("path").mapInPandas(run, _REPAIR), "inspected")


def quarantine(decided: DataFrame, trash: str, dry_run: bool = True) -> DataFrame:
    """Outcome of moving what repair.decide() sends to quarantine."""
    from .moves import planned
    from .names import reserved

    rows = decided.filter("status = 'quarantined'").select(F.col("path").alias("src"), F.concat(F.lit(trash.rstrip("/") + "/"), F.substring_index("path", "/", -1)).alias("dest"))
    there = decided.sparkSession.createDataFrame([(f"{trash.rstrip('/')}/{n}",) for n in (os.listdir(trash) if os.path.isdir(trash) else [])], "path string")
    return execute(reserved(rows, there).select(*planned("move", F.col("src"), F.col("dest"))), dry_run)


def links_supported(a: str, b: str) -> dict[str, bool]:
    """What this platform and the two folders allow: hard links need one device."""
    try:
        same = os.stat(a).st_dev == os.stat(b).st_dev
    except OSError:
        same = False
    return {"hardlink": same and hasattr(os, "link"), "symlink": hasattr(os, "symlink") and os.name != "nt", "admin": hasattr(os, "geteuid") and os.geteuid() == 0}


def stamp(text: str) -> datetime:
    """A date with or without a time."""
    for form in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d"):
        try:
            return datetime.strptime(text, form)
        except ValueError:
            continue
    raise ValueError(f"no date: {text!r}; write YYYY-MM-DD or YYYY-MM-DD HH:MM:SS")
