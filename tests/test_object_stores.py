"""Commits where a put if absent is all there is: a file system made for this, in Spark sessions of their own."""

import glob
import os
import shutil
import subprocess
import sys
import textwrap

import pyspark
import pytest

JARS = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "hadoop-client-*.jar"))
HERE = os.path.dirname(os.path.abspath(__file__))
pytestmark = pytest.mark.skipif(not shutil.which("javac"), reason="needs a Java compiler")


@pytest.fixture(scope="module")
def classes(tmp_path_factory):
    folder = tmp_path_factory.mktemp("classes")
    subprocess.run(["javac", "-nowarn", "-cp", ":".join(JARS), "-d", str(folder), os.path.join(HERE, "java", "PutOnly.java")], check=True)
    return folder


def started(classes, body, *args, **conf):
    settings = {"spark.driver.extraClassPath": str(classes), "spark.hadoop.fs.putonly.impl": "PutOnly", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "2", "spark.ui.showConsoleProgress": "false"} | {k.replace("__", "."): v for k, v in conf.items()}
    text = f"import sys\nfrom pyspark.sql import SparkSession\nimport tallyrun as t\nspark = SparkSession.builder.master('local[2]').config(map={settings!r}).getOrCreate()\nroot, *rest = sys.argv[1:]\n" + textwrap.dedent(body)
    return subprocess.Popen([sys.executable, "-c", text, *args], cwd=os.path.dirname(HERE), stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True)


def ended(process):
    out, err = process.communicate(timeout=300)
    assert process.returncode == 0, err[-3000:]
    return out.split()


WRITER = """
    store = t.Store(spark, root)
    for k in range(12):
        store.stow(spark.range(k).selectExpr("id", f"'{rest[0]}' AS writer"), "log", label=f"{rest[0]}{k}")
    store.stow(spark.range(3), "numbers", shape="versioned")
    print(type(store.files._create_once).__name__)
"""
READER = """
    store = t.Store(spark, root)
    print(len(store.log.runs), len(store.log.chunks), store.grab("log", run="all").count(), store.grab("numbers").count(), store.log.next, store.log.tables["log"]["row_count"])
"""


@pytest.mark.parametrize("conf", [{"spark__hadoop__putonly__conditional": "true"}, {"spark__tallyrun__putIfAbsent": "putonly", "spark__hadoop__putonly__silent": "true"}])
def test_two_writers_put_if_absent(classes, tmp_path, conf):
    """Of two writers each commit is one's; with "silent" some answers to puts that were done are lost."""
    root = f"putonly://{tmp_path}/store"
    both = [started(classes, WRITER, root, name, **conf) for name in ("a", "b")]
    for process in both:
        ended(process)
    runs, chunks, rows, numbers, commits, counted = map(int, ended(started(classes, READER, root, **conf)))
    assert runs == 2 * 13 and chunks == 2 * 12 and rows == counted == 2 * sum(range(12)) and numbers == 3
    names = sorted(x for x in os.listdir(tmp_path / "store" / "_log") if x.endswith(".json"))
    assert names == [f"{k:020d}.json" for k in range(commits)]


def test_others_are_refused_before_anything_is_written(classes, tmp_path):
    body = """
        try:
            t.Store(spark, root)
        except t.StoreError as e:
            print("refused" if "putIfAbsent" in str(e) else e)
    """
    assert ended(started(classes, body, f"putonly://{tmp_path}/store")) == ["refused"]
    assert os.listdir(tmp_path) == []
