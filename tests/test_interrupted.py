"""Writers killed at each step: the catalog never names what is gone, and what they left is cleared."""

import os
import shutil

import pytest
from test_warehouse import INTERPRO, config, put

from strandline.sources import files
from strandline.sources.warehouse import Refused, Warehouse


class Killed(BaseException):
    """Ends a writer: no cleaning up gets through any more."""


class Killer:
    """Lets so many changes of the store through, then none."""

    def __init__(self, monkeypatch, after: int):
        self.left, self.dead = after, False
        for name in ("write_text", "rename", "remove"):
            monkeypatch.setattr(files, name, self.wrap(getattr(files, name)))

    def wrap(self, change):
        def guarded(*args, **kwargs):
            if self.left == 0:
                self.dead = True
                raise Killed
            self.left -= 1
            return change(*args, **kwargs)

        return guarded


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    """A store with one assembly."""
    top = tmp_path_factory.mktemp("kept")
    Warehouse.create(spark, f"file://{top}/store").load(config(top))
    return top


def folders(root):
    found = {f"{kind}/{n}" for kind in ("assemblies", "functional") if os.path.isdir(f"{root}/{kind}") for n in os.listdir(f"{root}/{kind}")}
    waiting = [n for kind in (".staging", "_work") if os.path.isdir(f"{root}/{kind}") for n in os.listdir(f"{root}/{kind}") if not n.endswith(".crc")]
    return found, waiting + [n for n in os.listdir(root) if n.startswith(".catalog-")]


def copied(w, source):
    """A load that takes the folder of another one: what is tested is what comes around it."""

    def stage(config, assembly_id, staging, *options):
        from strandline.sources.warehouse import LoadReport

        shutil.copytree(source, staging.removeprefix("file://"))
        files.write_text(w.spark, f"{staging}/manifest.json", files.read_bytes(w.spark, f"{staging}/manifest.json").decode())
        return LoadReport(assembly_id, "", 1, 1, 0)

    w._stage = stage


def attached(w, tmp_path):
    def attach(folder, out, *rest):
        shutil.copytree(f"{folder.removeprefix('file://')}/annotation", f"{out.removeprefix('file://')}/annotation")
        shutil.copytree(f"{folder.removeprefix('file://')}/annotation_run", f"{out.removeprefix('file://')}/annotation_run")
        return {}

    w._attach = attach
    w.attach_functional(1, put(tmp_path, "hits.tsv", INTERPRO))


def work(kind, w, top, tmp_path):
    entry = w.catalog()["assemblies"][0]
    copied(w, f"{w.root.removeprefix('file://')}/{entry['folder']}")
    c = config(top)
    if kind == "load":
        import dataclasses

        w.load(dataclasses.replace(c, assembly="another"))
    elif kind == "again":
        w.load(c, force=True)
    elif kind == "attach":
        attached(w, tmp_path)
    else:
        w.remove(1, keep_files=kind == "forget")


@pytest.mark.parametrize("kind", ["load", "again", "attach", "remove", "forget"])
def test_killed_at_each_step(spark, loaded, tmp_path, monkeypatch, kind):
    outcomes = set()
    for n in range(40):
        root = f"{tmp_path}/{n}"
        shutil.copytree(f"{loaded}/store", root)
        before = Warehouse(spark, f"file://{root}").catalog()
        with monkeypatch.context() as m:
            killer = Killer(m, n)
            try:
                work(kind, Warehouse(spark, f"file://{root}"), loaded, tmp_path)
            except Killed:
                pass
        w = Warehouse(spark, f"file://{root}")
        named = w._named(w.catalog())
        assert named <= folders(root)[0], n  # nothing that is named is gone
        for a in w.catalog()["assemblies"]:
            assert w.table(a["assembly_id"], "sequence").count() == 1
        if not killer.dead:
            break
        cleared = w.recover()  # what can't be published any more; a writer that may live is left alone
        cleared += w.recover(fence=True)
        assert w.recover(fence=True) == []
        found, waiting = folders(root)
        kept = set() if kind != "forget" else w._named(before)
        assert found - kept == w._named(w.catalog()) - kept and waiting == [], n
        changed = [a["label"] for a in w.catalog()["assemblies"]] != [a["label"] for a in before["assemblies"]] or named != w._named(before)
        outcomes |= {(changed, c["outcome"]) for c in cleared}
    assert not killer.dead and n > 3
    assert (False, "undone") in outcomes and (True, "finished") in outcomes
    assert not outcomes - {(False, "undone"), (True, "finished")}
    found, waiting = folders(root)
    assert waiting == [] and (kind == "forget" or found == w._named(w.catalog()))


def test_the_next_load_says_what_it_cleared(spark, loaded, tmp_path, monkeypatch):
    root = f"{tmp_path}/store"
    shutil.copytree(f"{loaded}/store", root)
    with monkeypatch.context() as m:
        Killer(m, 4)  # the record and its rename, the manifest, the folder in place
        with pytest.raises(Killed):
            work("load", Warehouse(spark, f"file://{root}"), loaded, tmp_path)
    assert len(folders(root)[0]) == 2
    w = Warehouse(spark, f"file://{root}")
    copied(w, f"{root}/{w.catalog()['assemblies'][0]['folder']}")
    report = w.load(config(loaded), force=True)
    assert any("an interrupted load of" in x and "was undone" in x for x in report.warnings)
    assert folders(root) == (w._named(w.catalog()), [])


def test_a_writer_that_was_fenced_off_is_refused(spark, loaded, tmp_path):
    root = f"{tmp_path}/store"
    shutil.copytree(f"{loaded}/store", root)
    w = Warehouse(spark, f"file://{root}")
    slow, stage = Warehouse(spark, f"file://{root}"), None
    copied(slow, f"{root}/{w.catalog()['assemblies'][0]['folder']}")
    stage = slow._stage

    def meanwhile(*args):
        report = stage(*args)
        assert w.recover() == []
        assert [c["kind"] for c in w.recover(fence=True)] == ["load"]
        return report

    slow._stage = meanwhile
    with pytest.raises(Exception):  # noqa: B017  its folder is gone, or its revision taken
        slow.load(config(loaded), force=True)
    assert folders(root) == (w._named(w.catalog()), []) and w.table(1, "sequence").count() == 1


def test_a_manifest_that_was_changed_stops_a_removal(spark, loaded, tmp_path):
    root = f"{tmp_path}/store"
    shutil.copytree(f"{loaded}/store", root)
    w = Warehouse(spark, f"file://{root}")
    path = f"{w.root}/{w.catalog()['assemblies'][0]['folder']}/manifest.json"
    text = files.read_bytes(spark, path).decode()
    files.write_text(spark, path, text + " ")
    with pytest.raises(Refused, match="not the one that was loaded"):
        w.remove(1)
    files.write_text(spark, path, text)
    w.remove(1)
