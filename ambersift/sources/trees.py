"""File trees with ignore files: folders are listed first, only files that stay are read.

A tree is listed level by level as a Spark job: each folder is a row, its task lists it,
reads the ignore files that lie in it, and hands its subfolders on with the places of the
ignore files above them. An ignored folder is a row of the result and nothing below it is
looked at. The files that stay are dealt to ranges of paths of about ``RANGE_BYTES`` and
read there.

Ignore files follow the usual rules of version control: a pattern with a slash at its
start or middle is bound to the folder of its file, any other holds at every depth below;
``*``, ``?`` and ``[..]`` do not match a slash, ``**`` matches folders; a final slash means
folders only; ``!`` takes a path back unless a folder above it is ignored; of all patterns
of the files of one name, the last that matches decides, inner folders after outer ones. A
path is ignored if the files of any of the given names say so.

Folders and files that cannot be read have a reason and no content. Links to folders are
not followed. Where the root is a URI, listing and reading go through Arrow's file systems.

Small files take a disk block each, and so does every folder. A ``packed`` tree keeps them
in ZIP archives (``pack_tree`` writes them): what an archive holds lies at the root, a top
folder in one archive as a whole; ignore files that hold for all of the tree lie beside the
archives. Listing and reading are the same, a folder at a time, out of the archive.
"""

from __future__ import annotations

import os
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .corpus import HEAD_CHARS, IGNORE_DIRS, MAX_FILE_BYTES, REPORT_MARKER, content_reason, path_reason

IGNORE_FILES = (".gitignore", ".scanignore")
RANGE_BYTES = 128 * 1024 * 1024
_BATCH_BYTES = 16 * 1024 * 1024
_BATCH_ROWS = 4096
PACK_FILES = 20_000
_PACK_ENDING = ".zip"
_LISTED = "path string, pack string, folder boolean, size long, skipped string, above array<string>"

Rule = tuple[re.Pattern, bool, bool]


def _glob(text: str) -> str:
    """A path pattern as a regular expression; ``**`` between slashes is any number of folders."""
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if text.startswith("**/", i) and (i == 0 or text[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if text[i:] == "**" and (i == 0 or text[i - 1] == "/"):
            return out + ".+"
        if c == "*":
            while text.startswith("*", i + 1):
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := text.find("]", i + 2 + (text[i + 1 : i + 2] in ("!", "^")))) > 0:
            inner = text[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out, i = out + "(?!/)[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end
        elif c == "\\" and i + 1 < len(text):
            i += 1
            out += re.escape(text[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def ignore_rules(text: str) -> list[Rule]:
    """(expression over the path below the file's folder, takes back, folders only) per line."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\) +$", "", line.removesuffix("\r"))
        back = line.startswith("!")
        line = line[1:] if back else line
        if not line or line.startswith("#") and not back:
            continue
        folders = line.endswith("/")
        line = line.rstrip("/") if folders else line
        bound = "/" in line
        shape = _glob(line.removeprefix("/"))
        try:
            out.append((re.compile(("" if bound else "(?:.*/)?") + shape, re.S), back, folders))
        except re.error:  # not a pattern, like a class that ends before it begins
            continue
    return out


class Pack:
    """An archive, its names arranged by folder."""

    def __init__(self, file):
        try:
            self.zip = zipfile.ZipFile(file)
        except zipfile.BadZipFile as err:
            raise OSError(str(err)) from err
        self.below: dict[str, dict[tuple[str, bool], int]] = {"": {}}
        for info in self.zip.infolist():
            folder, _, name = info.filename.rstrip("/").rpartition("/")
            self._folder(folder)[name, info.is_dir()] = info.file_size

    def _folder(self, path: str) -> dict[tuple[str, bool], int]:
        if path not in self.below:
            self.below[path] = {}
            above, _, name = path.rpartition("/")
            self._folder(above)[name, True] = 0
        return self.below[path]

    def entries(self, folder: str) -> list[tuple[str, bool, int]]:
        return sorted((name, is_folder, size) for (name, is_folder), size in self.below.get(folder, {}).items())

    def read(self, path: str) -> bytes:
        try:
            return self.zip.read(path)
        except (KeyError, zipfile.BadZipFile) as err:
            raise OSError(str(err)) from err


class Tree:
    """Listing and reading below a root, which is a path or a URI; ``pack`` names the archive
    that holds a folder or file, none for what lies there itself."""

    def __init__(self, root: str):
        self.fs, self.top = None, root.rstrip("/")
        if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]+:", root) and not root.startswith("file:"):
            from pyarrow import fs

            self.fs, self.top = fs.FileSystem.from_uri(root.rstrip("/"))
        else:
            self.top = re.sub(r"^file:(?://)?", "", self.top)
        self.rules = lru_cache(4096)(self._rules)
        self.pack = lru_cache(2)(self._pack)

    def _at(self, path: str) -> str:
        return f"{self.top}/{path}" if path else self.top

    def _pack(self, name: str) -> Pack:
        return Pack(self._at(name) if self.fs is None else self.fs.open_input_file(self._at(name)))

    def entries(self, folder: str, pack: str | None = None) -> list[tuple[str, bool, int]]:
        """(name, is a folder, size) of what lies in a folder, by name."""
        if pack is not None:
            return self.pack(pack).entries(folder)
        if self.fs is not None:
            from pyarrow import fs

            found = self.fs.get_file_info(fs.FileSelector(self._at(folder)))
            return sorted((f.base_name, f.type == fs.FileType.Directory, f.size or 0) for f in found)
        out = []
        with os.scandir(self._at(folder)) as it:
            for e in it:
                if e.is_dir(follow_symlinks=False):
                    out.append((e.name, True, 0))
                elif e.is_file():
                    out.append((e.name, False, e.stat().st_size))
        return sorted(out)

    def read(self, path: str, pack: str | None = None) -> bytes:
        if pack is not None:
            return self.pack(pack).read(path)
        if self.fs is not None:
            with self.fs.open_input_stream(self._at(path)) as f:
                return f.read()
        with open(self._at(path), "rb") as f:
            return f.read()

    def _rules(self, path: str, pack: str | None) -> list[Rule]:
        try:
            return ignore_rules(self.read(path, pack).decode("utf-8", "replace"))
        except OSError:
            return []

    def ignored(self, path: str, folder: bool, above: Sequence[str], names: Sequence[str], pack: str | None = None) -> bool:
        """Whether the ignore files ``above`` (outer ones first) leave the path out. Those at the
        top lie beside the archives."""
        for name in names:
            verdict = False
            for file in above:
                base, _, own = file.rpartition("/")
                if own != name:
                    continue
                below = path[len(base) + 1 :] if base else path
                for shape, back, folders in self.rules(file, pack if base else None):
                    if (folder or not folders) and shape.fullmatch(below):
                        verdict = not back
            if verdict:
                return True
        return False


def list_tree(
    spark: SparkSession, root: str, ignore_files: Sequence[str] = IGNORE_FILES, skip_folders: Sequence[str] = IGNORE_DIRS,
    packed: bool = False,
) -> DataFrame:
    """(path, folder, size, skipped): all files, and the folders that are left out, with the
    reason; nothing below those is listed. No byte is read but those of ignore files. Of a
    ``packed`` tree, also the archive (pack) of each."""
    names, skip = tuple(ignore_files), frozenset(skip_folders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, rows = Tree(root), []
        for batch in batches:
            for place, pack, above in zip(*(batch[c].to_pylist() for c in ("path", "pack", "above"))):
                prefix = f"{place}/" if place else ""
                try:
                    found = tree.entries(place, pack)
                except OSError:
                    rows.append({"path": place or pack or "", "pack": pack, "folder": True, "size": 0, "skipped": "unreadable", "above": []})
                    continue
                here = {n for n, folder, _ in found if not folder and (place or pack is None)}
                above = above + [prefix + n for n in names if n in here]
                for name, folder, size in found:
                    if packed and not place and pack is None and not folder and name.endswith(_PACK_ENDING):
                        rows.append({"path": "", "pack": name, "folder": True, "size": 0, "skipped": None, "above": above})
                        continue
                    why = "ignored folder" if folder and name in skip else None
                    if why is None and tree.ignored(prefix + name, folder, above, names, pack):
                        why = "ignored"
                    rows.append({"path": prefix + name, "pack": pack, "folder": folder, "size": size, "skipped": why, "above": above if folder else []})
                if len(rows) >= _BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema(
        [("path", pa.string()), ("pack", pa.string()), ("folder", pa.bool_()), ("size", pa.int64()), ("skipped", pa.string()),
         ("above", pa.list_(pa.string()))]
    )
    level = spark.createDataFrame([("", None, [])], "path string, pack string, above array<string>")
    out, parts = None, 1
    while True:
        found = Observation()
        more = F.count_if(F.col("folder") & F.col("skipped").isNull()).alias("n")
        # Folders of an archive go to few tasks, as each reads its names.
        dealt = level.repartitionByRange(parts, "pack", "path") if packed else level.repartition(parts)
        step = written(dealt.mapInArrow(run, _LISTED).observe(found, more))
        open_ = F.col("folder") & F.col("skipped").isNull()
        rows = step.filter(~open_).drop("above")
        out = rows if out is None else out.unionByName(rows)
        if not found.get["n"]:
            return out if packed else out.drop("pack")
        level = step.filter(open_).select("path", "pack", "above")
        parts = min(found.get["n"], 4 * spark.sparkContext.defaultParallelism)


def read_listed(
    listed: DataFrame, root: str, range_bytes: int = RANGE_BYTES, on_read: Callable[[str, int], None] | None = None
) -> DataFrame:
    """(path, size, content) of listed files, a range of paths in each task; null content
    where a file could not be read. ``on_read`` is told of every file and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(root)
        for batch in batches:
            rows, held = [], 0
            for path, pack, size in zip(*(batch[c].to_pylist() for c in ("path", "pack", "size"))):
                try:
                    data = tree.read(path, pack)
                except OSError:
                    data = None
                if on_read and data is not None:
                    on_read(path, len(data))
                rows.append({"path": path, "size": size, "content": None if data is None else data.decode("utf-8", "replace")})
                held += size
                if held >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("content", pa.large_string())])
    total = listed.agg(F.sum("size")).first()[0] or 0
    pack = F.col("pack") if "pack" in listed.columns else F.lit(None).cast("string")
    files = listed.select("path", pack.alias("pack"), "size")
    ranges = files.repartitionByRange(int(total // range_bytes) + 1, "pack", "path").sortWithinPartitions("pack", "path")
    return ranges.mapInArrow(run, "path string, size long, content string")


def judged_tree(
    spark: SparkSession, root: str, ignore_files: Sequence[str] = IGNORE_FILES, ignore_paths: Sequence[str] = (),
    max_bytes: int = MAX_FILE_BYTES, packed: bool = False,
) -> DataFrame:
    """``list_tree`` with every reason that a path or a size gives."""
    listed = list_tree(spark, root, ignore_files, packed=packed)
    big = F.when(~F.col("folder") & (F.col("size") > max_bytes), F.lit("too large"))
    return listed.withColumn("skipped", F.coalesce("skipped", path_reason(F.col("path"), ignore_paths), big))


def read_corpus_tree(
    spark: SparkSession, root: str, project: str | None = None, ignore_files: Sequence[str] = IGNORE_FILES,
    ignore_paths: Sequence[str] = (), marker: str = REPORT_MARKER, max_bytes: int = MAX_FILE_BYTES,
    on_read: Callable[[str, int], None] | None = None, packed: bool = False,
) -> DataFrame:
    """The corpus of a tree as (project, path, content), its ignore files and the exclusions
    of ``corpus`` applied; only files that names and sizes keep are read. The project is the
    first folder below ``root`` unless one is given."""
    listed = judged_tree(spark, root, ignore_files, ignore_paths, max_bytes, packed)
    files = read_listed(listed.filter(~F.col("folder") & F.col("skipped").isNull()), root, on_read=on_read)
    path, content = F.col("path"), F.col("content")
    why = content_reason(path, F.left(content, F.lit(HEAD_CHARS)), F.octet_length(content), marker, max_bytes)
    files = files.filter(content.isNotNull() & why.isNull())
    if project is not None:
        return files.select(F.lit(project).alias("project"), "path", "content")
    return files.select(
        F.substring_index("path", "/", 1).alias("project"), F.regexp_replace("path", r"^[^/]*/", "").alias("path"), "content"
    )


def pack_tree(files: DataFrame, root: str, pack_files: int = PACK_FILES) -> None:
    """Land files (path, content) as a packed tree below ``root``, a folder that all tasks
    reach: archives of about ``pack_files`` files, a top folder in one of them. Of equal paths
    the greatest text is kept; a null text is empty, an empty path no file."""
    top = re.sub(r"^file:(?://)?", "", root)
    files = files.filter(F.col("path") != "")
    packs = files.count() // pack_files + 1

    def land(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(top, exist_ok=True)
        name = f"pack-{TaskContext.get().partitionId():06d}{_PACK_ENDING}"
        # Under another name first: a repeated task never shows half an archive.
        made = f"{top}/.{name}.{uuid.uuid4().hex}"
        held = None
        with zipfile.ZipFile(made, "w") as out:
            for batch in batches:
                for path, text in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                    if held is not None and held[0] != path:
                        out.writestr(zipfile.ZipInfo(held[0]), held[1], zipfile.ZIP_DEFLATED, 1)
                    held = path, text or ""
                yield batch.select(["path"])
            if held is not None:
                out.writestr(zipfile.ZipInfo(held[0]), held[1], zipfile.ZIP_DEFLATED, 1)
        os.replace(made, f"{top}/{name}")

    dealt = files.select("path", "content").repartition(packs, F.substring_index("path", "/", 1))
    dealt.sortWithinPartitions("path", "content").mapInArrow(land, "path string").count()
