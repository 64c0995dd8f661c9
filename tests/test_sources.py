import os

import pytest

from sourcelens.sources import files as S


def tree(root, **more):
    for path, text in {"src/__init__.py": "x = 1", ".env.example": "A=1", ".env": "A=secret", "node_modules/a.js": "x", "a.png": "x", "src/keep.log": "k", "src/drop.log": "d", "build.rs": "fn main() {}", **more}.items():
        os.makedirs(os.path.dirname(f"{root}/{path}") or root, exist_ok=True)
        with open(f"{root}/{path}", "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


def test_tree(spark, tmp_path):
    root = str(tmp_path)
    tree(root, **{".gitignore": "*.log\n!keep.log\n/ignored/\n", "ignored/x.rs": "no", "bad.rs": b"\xff\xfe", "empty/.gitignore": "", "big.rs": "x" * (2 << 20) + "y"})
    os.symlink(f"{root}/build.rs", f"{root}/src/link.rs")
    os.link(f"{root}/build.rs", f"{root}/src/hard.rs")
    rows = {r["path"]: (r["text"], r["reason"]) for r in S.load(spark, root).collect()}
    texts = {p for p, (t, _) in rows.items() if t is not None}
    assert texts == {"src/__init__.py", ".env.example", "src/keep.log", ".gitignore", "empty/.gitignore"}
    reasons = {p: r for p, (_, r) in rows.items() if r}
    assert reasons == {".": "ignore_file", ".env": "denied", "node_modules": "pruned", "a.png": "binary", "bad.rs": "non_utf8", "src/link.rs": "not_regular", "src/hard.rs": "metadata", "build.rs": "metadata", "big.rs": "metadata"}
    assert S.load(spark, root, texts=False).where("reason is null").count() == len(texts) + 1
    good, cut = S.capped(S.load(spark, root, texts=False))
    assert good.count() == 6 and not cut


@pytest.mark.parametrize(("line", "path", "is_dir", "hit"), [("*.o", "a/b.o", False, True), ("/a", "b/a", False, False), ("a/", "a", False, False), ("a/**/b", "a/x/y/b", False, True), ("**/c", "x/c", False, True), ("doc/*.t", "doc/a/b.t", False, False), ("[ab].c", "b.c", False, True), ("\\!x", "!x", False, True)])
def test_ignore(line, path, is_dir, hit):
    assert S.ignored(S.ignore_lines(line, ""), path, is_dir) == hit


def test_root(tmp_path):
    project = tmp_path / "p"
    (project / "src").mkdir(parents=True)
    (project / "Cargo.toml").write_text("")
    os.chmod(project, 0o755), os.chmod(project / "src", 0o755), os.chmod(tmp_path, 0o755)
    assert S.project_root(str(project / "src"), home="/nobody") == str(project)
    with pytest.raises(ValueError):
        S.project_root(str(project / "src"), home=str(project))


def test_replaced_root(spark, tmp_path):
    """A root that another directory has taken the place of is refused when it is read, not only when loaded."""
    root = tmp_path / "r"
    root.mkdir()
    tree(str(root))
    df = S.load(spark, str(root))
    assert df.count() > 3
    os.rename(root, tmp_path / "old")
    root.mkdir()
    tree(str(root))
    with pytest.raises(Exception, match="root was replaced"):
        df.count()


def test_discovery_caps(spark, tmp_path, monkeypatch):
    tree(str(tmp_path))
    whole, cut = S.load_capped(spark, str(tmp_path))
    assert not cut and whole.where("text is not null").count() == 5
    monkeypatch.setattr(S, "MAX_FILES", 2)
    some, cut = S.load_capped(spark, str(tmp_path))
    assert cut and [r["path"] for r in some.where("text is not null").orderBy("path").collect()] == [".env.example", "build.rs"]
    assert some.where("reason is not null").count() == whole.where("reason is not null").count()


def test_parts_are_the_whole_tree(tmp_path):
    """However a tree is cut, its rows are those of one walk; a large directory is several parts."""
    root = str(tmp_path)
    tree(root, **{".gitignore": "*.log\n", "a/.gitignore": "!keep.log\n/x\n", "a/keep.log": "1", "a/x/y.rs": "no", "a/b/c/d.rs": "1", "a/b/e.log": "1", ".git/info/exclude": "secret*\n", "a/b/secret.rs": "1", "target/o.rs": "1", **{f"wide/f{i:03d}.rs": "1" for i in range(95)}, "wide/.ignore": "f00*\n"})
    whole = sorted(map(str, S.walk(root)))
    assert not any("'a/x/" in r or "secret" in r or "f001" in r for r in whole) and any("keep.log" in r for r in whole)
    for want in (1, 2, 4, 50):
        for chunk in (10, 5000):
            parts = S.plan(root, want, chunk)
            rows = []
            for rel, deep, names in parts:
                own = [(rel or ".", "ignore_file", *[None] * 6)] if names == frozenset() and S.own_rules(root, rel) else S.walk(root, rel, deep, names)
                rows += map(str, own)
            assert sorted(rows) == whole, (want, chunk)
    assert sum(rel == "wide/" for rel, _, _ in S.plan(root, 50, 10)) > 9


def test_filters_are_pushed(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, In, IsNull, StringStartsWith

    root = str(tmp_path)
    tree(root, **{"src/deep/a.rs": "a", "src/b.rs": "b", "lib/c.rs": "c"})
    reader = S._Reader(root, True, S.identity(root))
    given = [EqualTo(("path",), "src/deep/a.rs"), IsNull(("reason",))]
    assert list(reader.pushFilters(given)) == given
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[:2] for r in rows] == [("src/deep/a.rs", "a")] and not any(p.rel.startswith("lib") for p in reader.partitions())
    reader = S._Reader(root, True, S.identity(root))
    list(reader.pushFilters([StringStartsWith(("path",), "lib/"), In(("path",), ("lib/c.rs", "src/b.rs", None))]))
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == ["lib/c.rs"]
    loaded = S.load(spark, root)
    assert [r["path"] for r in loaded.where("path = 'src/b.rs' and reason is null").collect()] == ["src/b.rs"]
    assert {r["path"] for r in loaded.where("path like 'src/%' and reason is null").collect()} == {"src/__init__.py", "src/keep.log", "src/drop.log", "src/b.rs", "src/deep/a.rs"}
    assert loaded.where("path = 'none'").count() == 0
