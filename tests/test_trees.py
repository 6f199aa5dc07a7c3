"""File trees: ignore files, what is read, what is left out and why."""

import pytest

from ambersift.sources.trees import Tree, ignore_rules, judged_tree, list_tree, pack_tree, read_corpus_tree


def kept(text, path, folder=False):
    verdict = False
    for shape, back, folders in ignore_rules(text):
        if (folder or not folders) and shape.fullmatch(path):
            verdict = not back
    return not verdict


@pytest.mark.parametrize(
    ("pattern", "ignored", "kept_"),
    [
        ("*.log", ["a.log", "x/y/b.log", ".log"], ["a.logs", "log"]),
        ("/top.txt", ["top.txt"], ["x/top.txt"]),
        ("doc/*.md", ["doc/a.md"], ["doc/x/a.md", "x/doc/a.md"]),
        ("**/gen", ["gen", "a/gen", "a/b/gen"], ["agen", "gen/x"]),
        ("gen/**", ["gen/a", "gen/a/b"], ["gen", "x/gen/a"]),
        ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["ab", "x/a/b"]),
        ("a?c", ["abc", "x/a-c"], ["a/c", "ac"]),
        ("[a-c]x", ["ax", "d/bx"], ["dx", "/x"]),
        ("[!a-c]x", ["dx"], ["ax", "a/x"]),
        ("# note", [], ["# note", "note"]),
        ("\\# note", ["# note"], ["note"]),
        ("\\!x", ["!x"], ["x"]),
        ("trail  ", ["trail"], ["trail  "]),
        ("space\\ ", ["space "], ["space"]),
        ("a+b(1).txt", ["a+b(1).txt"], ["aab1.txt"]),
        ("", [], [""]),
        ("*", ["a", "a/b"], []),
        ("foo**bar", ["foobar", "fooxbar"], ["foo/bar"]),
        ("ü*", ["über", "x/ü"], ["u"]),
        ("[z-a]", [], ["z", "a"]),
    ],
)
def test_patterns(pattern, ignored, kept_):
    for p in ignored:
        assert not kept(pattern, p), p
    for p in kept_:
        assert kept(pattern, p), p


def test_folders_only_and_order():
    assert kept("build/", "build") and not kept("build/", "build", True) and not kept("build/", "x/build", True)
    assert kept("*.md\n!keep.md", "keep.md") and not kept("!keep.md\n*.md", "keep.md")
    assert not kept("*.md\n!keep.md\r\nkeep*\r\n", "keep.md")


FILES = {
    ".gitignore": "*.log\n/secret/\ngen/*\n!gen/keep.py\nbig.bin\n",
    "app/.gitignore": "!audit.log\nlocal.py\n/only_here.py\n",
    "app/.scanignore": "skipme/\n",
    "app/main.py": "print(1)", "app/audit.log": "taken back", "app/x.log": "no", "app/local.py": "no", "app/sub/local.py": "no",
    "app/only_here.py": "no", "app/sub/only_here.py": "yes", "app/skipme/a.py": "no", "app/deep/skipme/b/c.py": "no",
    "secret/k.py": "no", "app/secret/k.py": "yes", "gen/a.py": "no", "gen/keep.py": "yes", "gen/sub/b.py": "no",
    "node_modules/m/index.js": "no", "app/pic.png": "no", "app/lib.min.js": "no", "app/zero.py": "a\x00b",
    "app/umlaut.py": "grün", "app/empty.py": "", "app/big.py": "x" * 3000, "space name/ü.py": "yes",
}


@pytest.fixture
def tree(tmp_path):
    for path, text in FILES.items():
        file = tmp_path / "t" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text, encoding="utf-8")
    (tmp_path / "t/app/latin.py").write_bytes(b"caf\xe9")
    (tmp_path / "t/app/loop").symlink_to(tmp_path / "t/app")
    return tmp_path


WANT = {
    ".gitignore", "app/.gitignore", "app/.scanignore", "app/main.py", "app/audit.log", "app/sub/only_here.py",
    "app/secret/k.py", "gen/keep.py", "app/umlaut.py", "app/empty.py", "app/latin.py", "space name/ü.py",
}


def test_only_files_that_stay_are_read(spark, tree):
    log = str(tree / "reads")

    def note(path, n):
        with open(log, "a", encoding="utf-8") as f:
            f.write(f"{path}\t{n}\n")

    got = {r.path: r.content for r in read_corpus_tree(spark, str(tree / "t"), project="p", max_bytes=2000, on_read=note).collect()}
    assert set(got) == WANT and got["app/umlaut.py"] == "grün" and got["app/latin.py"] == "caf�"
    read = [line.split("\t")[0] for line in open(log, encoding="utf-8").read().splitlines()]
    assert sorted(read) == sorted(WANT | {"app/zero.py"})


def test_everything_left_out_has_a_reason(spark, tree):
    got = {r.path: r.skipped for r in judged_tree(spark, str(tree / "t"), max_bytes=2000).collect()}
    assert {p for p, why in got.items() if why is None} == WANT | {"app/zero.py"}
    assert got["secret"] == got["app/skipme"] == got["gen/sub"] == got["app/x.log"] == "ignored"
    assert got["node_modules"] == "ignored folder" and got["app/pic.png"] == "ignored kind" and got["app/big.py"] == "too large"
    assert not any(p.startswith(("secret/", "node_modules/", "app/skipme/", "gen/sub/", "app/loop")) for p in got)


def test_projects_uris_and_missing_roots(spark, tree):
    rows = read_corpus_tree(spark, f"file://{tree}/t", ignore_files=(), max_bytes=2000).collect()
    assert {(r.project, r.path) for r in rows} >= {("app", "main.py"), ("secret", "k.py"), ("space name", "ü.py")}
    assert [tuple(r) for r in list_tree(spark, str(tree / "none")).collect()] == [("", True, 0, "unreadable")]
    (tree / "empty").mkdir()
    assert read_corpus_tree(spark, str(tree / "empty")).count() == 0


def test_tree_reads_through_arrow(tree):
    from pyarrow import fs

    local, arrow = Tree(str(tree / "t")), Tree(str(tree / "t"))
    arrow.fs = fs.LocalFileSystem()
    assert [e for e in arrow.entries("gen")] == local.entries("gen") and arrow.read("app/main.py") == b"print(1)"


def test_packed_tree_is_the_same_tree_in_few_files(spark, tmp_path):
    """Before, every file and folder took a disk block of its own."""
    texts = {p: t for p, t in FILES.items() if p != ".gitignore"} | {f"many/d{i}/f{i}.py": f"x = {i}" for i in range(300)}
    for root in ("plain", "packed"):
        (tmp_path / root).mkdir()
        (tmp_path / root / ".gitignore").write_text(FILES[".gitignore"], encoding="utf-8")
    for path, text in texts.items():
        file = tmp_path / "plain" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text, encoding="utf-8")
    rows = [*texts.items(), ("app/main.py", FILES["app/main.py"]), ("many/none.py", None), ("", "no file")]
    (tmp_path / "plain/many/none.py").write_text("")
    packed = str(tmp_path / "packed")
    pack_tree(spark.createDataFrame(rows, "path string, content string"), packed, pack_files=100)
    assert len([*(tmp_path / "packed").rglob("*")]) <= 6  # archives and the top's ignore file

    def read(root, **how):
        return sorted(map(tuple, read_corpus_tree(spark, str(tmp_path / root), max_bytes=2000, **how).collect()))

    assert read("packed", packed=True) == read("plain") and len(read("plain")) > 300
    listed = [sorted(map(tuple, judged_tree(spark, str(tmp_path / r), max_bytes=2000, packed=p).select("path", "folder", "size", "skipped").collect()))
              for r, p in (("plain", False), ("packed", True))]
    assert listed[0] == listed[1]
    (tmp_path / "packed/broken.zip").write_bytes(b"no archive")
    assert ("broken.zip", "unreadable") in [(r.path, r.skipped) for r in list_tree(spark, packed, packed=True).collect()]
