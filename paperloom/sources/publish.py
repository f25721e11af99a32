"""Result tables that readers see whole, one or several at once.

A publication writes all tables aside, checks them, and writes a journal before
it moves anything. A second file, created only if absent, commits it. Until that
file is there the old tables are the valid ones, wherever they lie at the
moment; from then on the new ones are. A publication that was interrupted is
taken back or finished by the next one, or by recover(); tables that somebody
else has written to since are left as they are, with an error.

A table's state is told by the names and sizes of its files: names of Spark's
files are unique to the job that wrote them.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

VERSION = 1


class PublicationError(RuntimeError):
    """recovery_required: files of the publication are left for inspection."""

    def __init__(self, message: str, recovery_required: bool = False):
        super().__init__(message)
        self.recovery_required = recovery_required


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _move(spark: SparkSession, source: str, target: str) -> None:
    fs, s = _fs(spark, source)
    _, t = _fs(spark, target)
    if fs.exists(t) or not fs.rename(s, t):
        raise OSError(f"{source} cannot become {target}")


def _text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file; an error if it is there."""
    fs, p = _fs(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()


def state_of(spark: SparkSession, table: str) -> str | None:
    """A digest of a table's files, or None without the table."""
    fs, path = _fs(spark, table)
    if not fs.exists(path):
        return None
    listed, each = [], fs.listFiles(path, True)
    while each.hasNext():
        f = each.next()
        name = f.getPath().toString()[len(fs.makeQualified(path).toString()) :]
        if not f.getPath().getName().startswith("."):
            listed.append(f"{name}:{f.getLen()}")
    return hashlib.sha256("\n".join(sorted(listed)).encode()).hexdigest()


def _journal(anchor: str) -> str:
    return f"{anchor.rstrip('/')}.publication.json"


def _committed(anchor: str, token: str) -> str:
    return f"{anchor.rstrip('/')}.{token}.committed"


def _owned(target: str, token: str, kind: str) -> str:
    return f"{target.rstrip('/')}.{token}.{kind}"


def _loaded(spark: SparkSession, anchor: str, allowed: Iterable[str]) -> dict:
    """The journal, if it can be trusted: every path in it follows from a target
    that may be published, and none of those comes twice."""
    digest = lambda v: isinstance(v, str) and re.fullmatch("[0-9a-f]{64}", v)
    try:
        data = json.loads(_text(spark, _journal(anchor)))
        token, entries = data["token"], data["entries"]
        may, seen = {t.rstrip("/") for t in allowed}, set()
        rules = [
            (data["version"] == VERSION, "unknown version"),
            (isinstance(token, str) and re.fullmatch("[0-9a-f]{32}", token), "no token"),
            (data["anchor"] == anchor.rstrip("/"), "another anchor"),
            (isinstance(entries, list) and bool(entries), "no entries"),
        ]
        for e in entries:
            rules += [
                (e["target"] in may and e["target"] not in seen, f"unexpected or repeated target {e['target']}"),
                (all(e[k] == _owned(e["target"], token, k) for k in ("stage", "backup")), "a path that is not its target's"),
                (digest(e["staged"]), "no state of the new table"),
                (e["previous"] is None or digest(e["previous"]), "no state of the old table"),
            ]
            seen.add(e["target"])
        for fine, reason in rules:
            if not fine:
                raise ValueError(reason)
        return data
    except (ValueError, KeyError, TypeError) as e:
        raise PublicationError(f"{_journal(anchor)} cannot be used: {e}", recovery_required=True) from e


def _taken_back(spark: SparkSession, entries: list[dict]) -> None:
    """The old tables where they were; an error, and no change, where a table is
    neither the old nor the new one. Doing it again changes nothing."""
    wrong = []
    for e in reversed(entries):
        now = state_of(spark, e["target"])
        if now not in (None, e["previous"], e["staged"]):
            wrong.append(f"{e['target']} was changed by others")
        elif e["previous"] is None:
            if now is not None:
                _delete(spark, e["target"])
        elif now != e["previous"]:
            if state_of(spark, e["backup"]) != e["previous"]:
                wrong.append(f"{e['backup']} is not the old table")
                continue
            if now is not None:
                _delete(spark, e["target"])
            _move(spark, e["backup"], e["target"])
    if wrong:
        raise PublicationError("; ".join(wrong), recovery_required=True)


def _cleaned(spark: SparkSession, anchor: str, data: dict) -> None:
    """What the publication left, the journal last but for the mark that says
    what the journal means."""
    for e in data["entries"]:
        for kind in ("stage", "backup"):
            _delete(spark, e[kind])
    _delete(spark, _journal(anchor))
    _delete(spark, _committed(anchor, data["token"]))


def recover(spark: SparkSession, anchor: str, allowed: Iterable[str]) -> str:
    """Ends a publication that was interrupted: '', 'taken back' or 'finished'.
    Nobody else may publish to the anchor at the time."""
    if not _exists(spark, _journal(anchor)):
        return ""
    data = _loaded(spark, anchor, allowed)
    if _exists(spark, _committed(anchor, data["token"])):
        for e in data["entries"]:
            if state_of(spark, e["target"]) != e["staged"]:
                raise PublicationError(f"{e['target']} was changed by others", recovery_required=True)
        done = "finished"
    else:
        _taken_back(spark, data["entries"])
        done = "taken back"
    _cleaned(spark, anchor, data)
    return done


def published(spark: SparkSession, target: str, anchor: str | None = None) -> DataFrame:
    """The table that is valid now, also while a publication is under way."""
    anchor, target = (anchor or target).rstrip("/"), target.rstrip("/")
    if _exists(spark, _journal(anchor)):
        data = json.loads(_text(spark, _journal(anchor)))
        if not _exists(spark, _committed(anchor, data["token"])):
            entry = next((e for e in data["entries"] if e["target"] == target), None)
            if entry and entry["previous"] is None:
                raise PublicationError(f"{target} is not published yet")
            if entry and _exists(spark, entry["backup"]):
                return spark.read.parquet(entry["backup"])
    return spark.read.parquet(target)


class Publication:
    """Tables to publish together; the anchor, the last of them to be moved, has
    the journal beside it. step is called before each change that readers or a
    recovery can see."""

    def __init__(self, spark: SparkSession, anchor: str, allowed: Iterable[str], step: Callable[[str], None] = lambda _: None):
        self.spark, self.anchor, self.step = spark, anchor.rstrip("/"), step
        self.allowed = {t.rstrip("/") for t in allowed}
        self.token, self.staged = uuid.uuid4().hex, []
        recover(spark, self.anchor, self.allowed)

    def add(self, df: DataFrame, target: str, valid: Callable[[DataFrame], bool] = lambda _: True) -> None:
        """Writes a table aside; an error if it does not pass its check."""
        target = target.rstrip("/")
        if target not in self.allowed or target in self.staged:
            raise ValueError(f"{target} is unexpected, or comes twice")
        stage = _owned(target, self.token, "stage")
        self.staged.append(target)
        df.write.parquet(stage)
        if not valid(self.spark.read.schema(df.schema).parquet(stage)):
            self.abandon()
            raise ValueError(f"{target}: the new table did not pass its check")

    def abandon(self) -> None:
        for target in self.staged:
            _delete(self.spark, _owned(target, self.token, "stage"))
        self.staged = []

    def commit(self) -> None:
        """Moves the tables in place, the anchor last. An error on the way takes
        everything back; what stops the process is for recover()."""
        if not self.staged:
            raise ValueError("nothing to publish")
        spark, entries = self.spark, []
        for target in sorted(self.staged, key=lambda t: (t == self.anchor, t)):
            stage, backup = _owned(target, self.token, "stage"), _owned(target, self.token, "backup")
            entries.append({"target": target, "stage": stage, "backup": backup, "previous": state_of(spark, target), "staged": state_of(spark, stage)})
        data = {"version": VERSION, "token": self.token, "anchor": self.anchor, "entries": entries}
        self.step("journal")
        aside = f"{_journal(self.anchor)}.{self.token}"
        _create(spark, aside, json.dumps(data))
        _move(spark, aside, _journal(self.anchor))  # an error if another publication is under way
        try:
            for e in entries:
                if e["previous"] is not None:
                    self.step(f"backup {e['target']}")
                    _move(spark, e["target"], e["backup"])
                self.step(f"replace {e['target']}")
                _move(spark, e["stage"], e["target"])
            self.step("commit")
            _create(spark, _committed(self.anchor, self.token), self.token)
        except Exception as error:
            _taken_back(spark, entries)
            _cleaned(spark, self.anchor, data)
            raise PublicationError(f"{error}; the old tables are in place") from error
        self.step("clean")
        _cleaned(spark, self.anchor, data)


def publish(df: DataFrame, target: str, valid: Callable[[DataFrame], bool] = lambda _: True) -> None:
    """Replaces one Parquet table if what was written passes a check; the old
    table stays otherwise. Works on any file system that Spark writes."""
    publication = Publication(df.sparkSession, target, [target])
    publication.add(df, target, valid)
    publication.commit()


def append_events(events: DataFrame, journal: str) -> None:
    events.write.mode("append").parquet(journal)


def batches(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of complete batches below a folder, in order."""
    fs, path = _fs(spark, folder)
    if not fs.exists(path):
        return []
    names = [str(s.getPath().getName()) for s in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))


def drop(spark: SparkSession, target: str) -> None:
    fs, path = _fs(spark, target)
    fs.delete(path, True)
