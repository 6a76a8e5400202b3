import random

import pytest
from pyspark.sql import functions as F

from revquarry.operators import compare, patch


VERSES = "salt oil rice leek dill kale mint sage thyme plum pear fig".split()


def text(words):
    return "".join(f"{w}\n" for w in words)


def edited(**changes):
    return [changes.get(w, w) for w in VERSES]


def test_nothing_to_say():
    assert patch.hunks(None, None) == []
    assert patch.hunks(text(VERSES), text(VERSES)) == []


def test_one_side_only():
    assert patch.hunks(None, "salt\noil\nrice\n") == ["@@ -1,1 +1,3 @@\n+salt\n+oil\n+rice\n"]
    assert patch.hunks("salt\noil\n", None) == ["@@ -1,2 +1,1 @@\n-salt\n-oil\n"]


def test_edits_closer_than_the_context_share_a_hunk():
    # One unchanged line between, three below: fewer than the four that would close the hunk.
    assert patch.hunks(text(VERSES[:7]), text(edited(oil="lard", leek="onion")[:7]), 4) == ["@@ -1,7 +1,7 @@\n salt\n-oil\n+lard\n rice\n-leek\n+onion\n dill\n kale\n mint\n"]


def test_distant_edits_have_their_own():
    # Each hunk closes with its second unchanged line, which the header leaves out.
    assert patch.hunks(text(VERSES), text(edited(oil="lard", plum="date")), 2) == ["@@ -1,3 +1,3 @@\n salt\n-oil\n+lard\n rice\n leek\n", "@@ -8,4 +8,4 @@\n sage\n thyme\n-plum\n+date\n pear\n fig\n"]


def test_text_that_ends_in_a_change():
    assert patch.hunks(text(VERSES), text(VERSES[:-1]), 2) == ["@@ -10,3 +10,3 @@\n plum\n pear\n-fig\n"]
    assert patch.hunks(text(VERSES[:3]), text([*VERSES[:2], "bran"]), 2) == ["@@ -1,4 +1,3 @@\n salt\n oil\n-rice\n+bran\n"]


def test_hunk_of_a_member():
    code = "import os\n\ndef first():\n    return 1\n\ndef second(x):\n    y = x\n\n    z = y\n    return z\n\ndef third():\n    return 3\n"
    new = code.replace("z = y", "z = y + 1")
    assert patch.hunks(code, new, 5, r"^\s*def ") == ["@@ -6,7 +6,7 @@\n def second(x):\n     y = x\n \n-    z = y\n+    z = y + 1\n     return z\n \n def third():\n"]
    # No line above begins a member: plain context.
    assert patch.hunks(code, new, 3, r"^\s*class ") == patch.hunks(code, new, 3)


def test_hunks_rebuild_the_new_text():
    """Where hunks don't overlap, putting them into the old text gives the new one."""
    rng = random.Random(7)
    for _ in range(300):
        old = [rng.choice("abcde") for _ in range(rng.randint(0, 40))]
        new = list(old)
        for _ in range(rng.randint(0, 4)):
            new.insert(rng.randint(0, len(new)), rng.choice("xyz"))
            del new[rng.randrange(len(new))]
        out, at = [], 0
        for runs in patch.clusters(patch.changed_runs(patch.edit_script(old, new)), 3):
            for run in runs:
                out += old[at : run.old.start] + new[run.new.start : run.new.stop]
                at = run.old.stop
        assert out + old[at:] == new


def test_too_little_context():
    with pytest.raises(ValueError):
        patch.hunks("a", "b", unified=1)


def test_line_ends():
    assert patch.split_lines("a\r\nb\rc\n") == ["a", "b", "c"]
    assert patch.split_lines("") == []


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_scripts_are_shortest_and_right():
    rng = random.Random(42)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        script, i, j = patch.edit_script(a, b), 0, 0
        for op in script:
            if op == " ":
                assert a[i] == b[j]
            i, j = i + (op != "+"), j + (op != "-")
        assert (i, j) == (len(a), len(b))
        assert script.count(" ") == longest_common(a, b)


@pytest.mark.parametrize(
    ("kinds", "text"),
    [(["Modified", "Renamed"], " 2 files changed\n\n"), (["Added"] * 2, " 2 insertions(+)\n\n"), (["Removed"] * 2, " 2 deletions(-)\n\n"), (["Modified", "Added", "Removed"], " 1 file changed, 1 insertion(+), 1 deletion(-)\n\n"), ([], " 0 file changed\n\n")],
)
def test_diffstat(spark, kinds, text):
    changes = spark.createDataFrame([(k,) for k in kinds], "type string")
    assert compare.diffstat(changes).first()["diffstat"] == text


def test_header_and_sections(spark):
    head = spark.range(1).select(patch.header(F.lit("Ada"), F.lit("ada@loom"), F.lit(1714565109), F.lit(-90), F.lit("Title"), "f" * 40).alias("h")).first()["h"]
    assert head == f"From {'f' * 40} Wed May 01 10:35:09 2024\nFrom: Ada <ada@loom>\nDate: Wed, 01 May 2024 10:35:09 +0000\nSubject: [PATCH] Title\n\n"
    changes = spark.createDataFrame([("Added", None, "notes.md", None, "1" * 40, None, "100644"), ("Added", None, "b.bin", None, "2" * 40, None, "100644")], "type string, old_path string, new_path string, old_oid string, new_oid string, old_mode string, new_mode string").withColumn("g", F.lit(0))
    blobs = spark.createDataFrame([("1" * 40, "weft", True), ("2" * 40, None, False)], "oid string, text string, is_text boolean")
    text = patch.patches(patch.file_sections(changes, blobs, "a" * 40, "b" * 40, by=("g",)), ("g",)).first()["patch"]
    assert text == " 2 insertions(+)\n\n--- a/dev/null\n+++ b/b.bin\nindex aaaaaaa..bbbbbbb 100644\nBinary files differ\n--- a/dev/null\n+++ b/notes.md\nindex aaaaaaa..bbbbbbb 100644\n@@ -1,1 +1,1 @@\n+weft\n"
