"""Generated files: the same for a number, and none stops the reader, the rules, the repairs or the painter."""

import random
import re

import pytest

from folioscan.functions import pdf_generator as g
from folioscan.operators.convert import fix_bytes, flatten_bytes
from folioscan.operators.rules import verify
from folioscan.sources.content_usage import page_dicts
from folioscan.sources.pdf import Walk, files_meta, nodes, unread_files
from folioscan.sources.pdf_bytes import Document, ParseError, tokenize_content


def test_seeds_are_files():
    found = g.seeds()
    assert len(found) == 8
    for name, data in found.items():
        doc = Document(data).open()
        assert doc.error is None and len(list(page_dicts(doc))) == 1, name
        box = doc.path("Root", "Pages", "Kids", "0", "MediaBox")
        assert box == ([0, 0, 90, 90] if name == "updated" else [0, 0, 72, 72])


@pytest.mark.parametrize("name", sorted(g.CORRUPTIONS))
def test_each_corruption_changes_each_seed(name):
    assert len(g.CORRUPTIONS) == 34
    for seed, data in g.seeds().items():
        bad = g.corrupt(seed, name, 1)
        assert bad != data and bad == g.corrupt(seed, name, 1)
        try:
            Walk(1, bad).run()
        except (ParseError, ValueError, TypeError, AttributeError, KeyError, IndexError, RecursionError):
            pass  # what nodes() turns into a row
        fix_bytes(bad, ["appearanceFixer", "fontMetricFixer", "deviceColourFixer", "resourceDictPruneFixer", "deviceNColorantsFixer", "fontSubsetMetaFixer", "transparencyFlattener"])
        flatten_bytes(bad, [1])
    assert g.CORRUPTIONS[name](b"", random.Random(1)) is not None


def test_generated_files(spark):
    assert [g.generate(k) for k in range(50)] == [g.generate(k) for k in range(50)] and g.generate_grammar(3) == g.generate_grammar(3)
    files = g.generate_files(spark, 0, 500)
    got = {r.file_id: bytes(r.content) for r in files.collect()}
    assert got == {k: g.generate(k) for k in range(500)} and len(set(got.values())) > 400
    rows = nodes(files)
    assert rows.where("kind = 'file'").count() == 500
    issues, results = verify(files, "strict_1b", reread=False)
    n = {r.file_id: r.n_issues for r in results.collect()}
    assert len(n) == 500 and sum(n.values()) == issues.count() and files_meta(files).count() == 500
    # what reading broke off in is told apart from what a file breaks
    reasons = [r.reason for r in unread_files(rows).collect()]
    assert len(reasons) < 100, reasons[:5]


def test_entries_of_no_bytes():
    """A table whose entries have no width says nothing of any object, however many it states; the file is recovered."""
    data = g.seeds()["table_stream"]
    bad = re.sub(rb"/W ?\[[^]]*\]", b"/W [0 0 0]", re.sub(rb"/Size \d+", b"/Size 1000000", data))
    doc = Document(bad).open()
    assert doc.error is None and len(doc.xref) < 10 and len(list(page_dicts(doc))) == 1


def test_comments_at_the_end():
    """Comments at the end of the data hold no token, however many signs begin one."""
    for end in (b"%" * 60, b"% \t" * 40, b"%abc"):
        assert tokenize_content(b"q Q " + end) == [("q", []), ("Q", [])]
