"""Scanning a folder whose name has characters of patterns."""

from lodestar.functions import ignore
from lodestar.sources import tables


def test_files_below_a_folder_with_a_dot_and_a_plus(spark, tmp_path):
    root = tmp_path / "a.b+c"
    for name, content in {"x.py": b"x = 1", "dist/y.py": b"y", "pkg/z.py": b"z", "pkg/.h/w.py": b"w", "b.py": b"\0bin"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    found = tables.source_files(spark, str(root), [".py"]).collect()
    assert sorted(r["path"].rsplit("a.b+c/", 1)[1] for r in found) == ["pkg/z.py", "x.py"]


def test_ignore_file_in_a_scan(spark, tmp_path):
    for name in ("keep.py", "gen/a.py", "gen/b.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    (tmp_path / "rules").write_text("# generated\ngen/*\n!gen/b.py\n")
    lines = ignore.patterns_of(spark, str(tmp_path / "rules"))
    found = tables.source_files(spark, str(tmp_path), ["py"], ignored=lines)
    assert sorted(r["path"].rsplit(f"{tmp_path}/")[-1] for r in found.collect()) == ["gen/b.py", "keep.py"]
