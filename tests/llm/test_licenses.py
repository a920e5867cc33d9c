"""License notices wrapped over lines."""

import textwrap

from earshot.llm import licenses


def test_wrapped_notices(spark):
    rows, want = [], set()
    for k, (label, t) in enumerate(licenses.TEMPLATES.items()):
        for width in (30, 72):
            for sign in ("", " * "):
                text = textwrap.fill("Some words stand before it here and there. " + t + " And other words follow.", width)
                rows.append((len(rows), "\n".join(sign + x for x in text.split("\n"))))
                want.add((rows[-1][0], label))
    apart = [(1000, "Copyright\n\nAll rights\n\nreserved."), (1001, "Copyright\n" + "word " * 40 + "\nAll rights reserved.")]
    df = spark.createDataFrame(rows + apart, "doc_id long, text string")
    got = {(r.doc_id, r.label) for r in licenses.scan(df)[1].collect()}
    assert want <= got
    assert not [d for d, _ in got if d >= 1000]
