"""Archives of pages whose keys repeat or are null."""

import hashlib

from grainwise.llm import warc


def test_pages_with_equal_key_and_payload_but_other_urls(spark):
    long = "z" * 1500
    rows = [(None, "a", None), (None, "b", ""), (None, "c", None), (7, "d", "short"), (7, "e", "short"), (8, "f", long), (8, "g", long), (8, None, long), (5, "h", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    captures = warc.captures(pages)
    assert sorted(r.response.target_uri or "" for r in captures.collect()) == ["", *"abcdefgh"]
    got = sorted((tuple(r) for r in warc.resolved(captures).collect()), key=str)
    sha = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    want = [(i, len(h or ""), sha(h), "revisit" if i == 5 else "response", 8 if i == 5 else None) for i, _, h in rows]
    assert got == sorted(want, key=str)
