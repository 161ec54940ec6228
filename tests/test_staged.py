"""Staged files read from repositories' folders, against git where it is installed, and from files made by hand."""

import os
import random
import shutil
import subprocess

import pytest

from seine.plans.scan import Scanner
from seine.samples import repository_files
from seine.sources import staged

TOKEN = "ghp_x7Kq2mZ9vT4bN8cR1wL5yH3jF6dS0aPuEgQi"


def git(repo, *args):
    env = os.environ | {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b", "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null"}
    return subprocess.run(["git", "-C", str(repo), "-c", "core.autocrlf=false", *args], env=env, capture_output=True, check=True).stdout.decode()


def changes(spark, *repos):
    rows = staged.staged_files(spark.createDataFrame([(str(r),) for r in repos], "path string")).collect()
    return sorted((r["repo"].rsplit("/", 1)[1], r["rel_path"], r["change"]) for r in rows)


def by_git(repo):
    lines = git(repo, "-c", "core.quotepath=false", "diff", "--cached", "--name-status", "--no-renames").splitlines()
    return sorted((repo.name, path, kind) for kind, path in (x.split("\t") for x in lines))


@pytest.mark.skipif(not shutil.which("git"), reason="git is not installed")
@pytest.mark.parametrize("version", [2, 3, 4])
@pytest.mark.parametrize("packed", [False, True])
def test_against_git(spark, tmp_path, version, packed):
    random.seed(version)
    repo = tmp_path / "r"
    repo.mkdir()
    git(repo, "init", "-q")
    (repo / "first.txt").write_text("x")
    git(repo, "add", "-A")
    assert changes(spark, repo) == by_git(repo) == [("r", "first.txt", "A")]  # no commit yet
    lines = [f"line {random.random()}" for _ in range(300)]
    for turn in range(4):
        for i in range(30):
            p = repo / f"d{i % 3}" / f"e{i % 2}" / f"ü f{i}.txt"
            p.parent.mkdir(parents=True, exist_ok=True)
            lines[random.randrange(300)] = f"turn {turn}"
            p.write_text("\n".join(lines[i:]))
        git(repo, "add", "-A")
        git(repo, "commit", "-q", "-m", str(turn))
    if packed:
        git(repo, "repack", "-q", "-a", "-d", "--depth=20", "--window=20")
        git(repo, "pack-refs", "--all")
        assert not list((repo / ".git/objects").glob("??/*"))
    assert changes(spark, repo) == []
    (repo / "d0" / "new.txt").write_text(TOKEN)
    (repo / "d1/e1/ü f1.txt").write_text("changed")
    (repo / "d2/e0/ü f2.txt").unlink()
    (repo / "d0/e0/ü f0.txt").chmod(0o755)
    git(repo, "add", "-A")
    (repo / "not-added.txt").write_text(TOKEN)
    (repo / "intent.txt").write_text(TOKEN)
    git(repo, "add", "-N", "intent.txt")
    git(repo, "update-index", "--index-version", str(version))
    assert changes(spark, repo) == by_git(repo) and [c for *_, c in changes(spark, repo)] == ["M", "A", "M", "D"]
    paths = staged.staged_paths(spark.createDataFrame([(str(repo),)], "path string"))
    found = Scanner().scan_paths(spark, str(repo), paths).findings
    assert [r["path"].rsplit("/", 1)[1] for r in found.collect()] == ["new.txt"]
    git(repo, "checkout", "-q", "--detach")
    assert changes(spark, repo) == by_git(repo)


@pytest.mark.skipif(not shutil.which("git"), reason="git is not installed")
def test_unsettled_merges(spark, tmp_path):
    repo = tmp_path / "m"
    repo.mkdir()
    git(repo, "init", "-q", "-b", "one")
    (repo / "a.txt").write_text("1\n")
    git(repo, "add", "-A")
    git(repo, "commit", "-q", "-m", "0")
    git(repo, "checkout", "-q", "-b", "two")
    (repo / "a.txt").write_text("2\n")
    git(repo, "commit", "-q", "-a", "-m", "2")
    git(repo, "checkout", "-q", "one")
    (repo / "a.txt").write_text("3\n")
    git(repo, "commit", "-q", "-a", "-m", "3")
    with pytest.raises(subprocess.CalledProcessError):
        git(repo, "merge", "two")
    assert changes(spark, repo) == [("m", "a.txt", "U")]


def test_files_made_by_hand(spark, tmp_path):
    before, now = {"a.txt": b"1", "d/b.txt": b"2", "d/e/c.txt": b"3"}, {"a.txt": b"1", "d/b.txt": b"two", "f.txt": b"4"}
    for name, content in repository_files(before, now).items():
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_bytes(content)
    assert changes(spark, tmp_path / "r") == [("r", "d/b.txt", "M"), ("r", "d/e/c.txt", "D"), ("r", "f.txt", "A")]
    (tmp_path / "r/.git/index").write_bytes(b"DIRC\0\0\0\5")
    with pytest.raises(Exception, match="not an index file"):
        changes(spark, tmp_path / "r")
    (tmp_path / "empty/.git").mkdir(parents=True)
    assert changes(spark, tmp_path / "empty") == []


def test_deltas():
    assert staged.patched(b"hello world", bytes([11, 8, 0x91, 6, 5, 3]) + b"!!!") == b"world!!!"
    assert staged._offset(bytes([0x80, 0x00]), 0) == (128, 2) and staged._offset(bytes([5]), 0) == (5, 1)
