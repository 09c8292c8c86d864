"""Listing apart from reading: depth, folders that can't be listed, names that look like patterns."""

import pytest

from loomtrace.sources import formats, listing


@pytest.fixture
def tree(tmp_path):
    for name in ("a.json", "one/b.json", "one/two/c.json", ".hidden/d.json", "shut/e.json", "shut/in/f.json", "odd [x]{y}*/g.json", "key=1/h.json", "key=x/k=2/i.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    return tmp_path


def names(df):
    return sorted(bytes(r["content"]).decode() for r in df.collect())


def test_depth_is_cut_before_reading(spark, tree):
    assert names(formats.read_files(spark, str(tree), 1)) == ["a.json"]
    assert names(formats.read_files(spark, f"file://{tree}", 2)) == sorted(["a.json", "one/b.json", ".hidden/d.json", "shut/e.json", "odd [x]{y}*/g.json", "key=1/h.json"])
    assert len(names(formats.read_files(spark, str(tree)))) == 9
    assert formats.read_files(spark, str(tree), 0).count() == 0
    listed = listing.list_files(spark, str(tree), 2)
    assert len(listed) == 6 and not any("two" in x for x in listed)


def test_folders_that_cannot_be_listed_are_skipped(spark, tree, monkeypatch):
    """The tests may run as a user with all rights, so the refusal is the file system's answer to a folder of that name."""
    plain = listing._statuses

    class Refusing:
        def __init__(self, fs):
            self.fs = fs

        def listStatus(self, path):
            # a folder that is none: the file system raises as it does without rights
            return self.fs.listStatus(path.suffix("/no/such") if path.getName() == "shut" else path)

    monkeypatch.setattr(listing, "_statuses", lambda fs, path: plain(Refusing(fs), path))
    found = names(formats.read_files(spark, str(tree)))
    assert len(found) == 7 and not any(x.startswith("shut") for x in found)


def test_single_files_patterns_and_missing_places(spark, tree):
    assert names(formats.read_files(spark, str(tree / "one/b.json"))) == ["one/b.json"]
    assert names(formats.read_files(spark, str(tree / "key=*"))) == ["key=1/h.json", "key=x/k=2/i.json"]
    with pytest.raises(FileNotFoundError):
        formats.read_files(spark, str(tree / "none"))
    (tree / "empty").mkdir()
    assert formats.read_files(spark, str(tree / "empty")).collect() == []
