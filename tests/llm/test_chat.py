import hashlib
import random

from faultbench.llm import chat
from faultbench.llm.chat import MarkedTurns, format_conversations, locate, read_back

SCHEMA = "conv_id long, turn long, role string, text string, block int, formatted int, turns int"
MARKS = ["### ", "</turn>", "\\", "#", "<", ":", "\n", "Assistant: ", "ä", "😀", "### Assistant: </turn> ok", ""]


def drops_thoughts():
    """A template that removes what an earlier turn thought once a later turn follows."""

    class DropsThoughts:  # local, so that workers get it by value
        context = None

        def render(self, turns, prompt=None):
            shown = [t if i == len(turns) - 1 else t.partition("</think>")[2] or t for i, (_, t) in enumerate(turns)]
            return "".join(f"<{r}>{t}\n" for (r, _), t in zip(turns, shown)) + (f"<{prompt}>" if prompt else "")

    return DropsThoughts()


def conversations(spark, n=40):
    random.seed(4)
    rows = []
    for c in [*range(n), None]:
        for i in range(random.randint(1, 9)):
            said = None if random.random() < 0.1 else "".join(random.choices(MARKS, k=random.randint(0, 6)))
            rows.append((c, None if random.random() < 0.05 else i, random.choice(["user", "assistant", None, "a:b"]), said))
    rows += [(99, i, "assistant" if i % 2 else "user", f"turn {i} <") for i in range(300)]  # over several blocks
    rows += [(98, 0, "assistant", "again")] * 3 + [(97, 0, "assistant", "z" * 100_000)]
    random.shuffle(rows)
    return rows, spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def wanted(rows):
    out = {}
    key = lambda r: tuple((x is not None, x) for x in (r[1],)) + ((r[2] or ""), (r[3] or ""))
    for c in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
        lost = "".join(t for r, t in own if r == "assistant")
        all_ = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        full = len(MarkedTurns().render(own))
        out[c] = (len(own), all_, len(lost), hashlib.sha256(lost.encode()).hexdigest(), full, 0)
    return out


def test_read_back_equals_the_table(spark):
    rows, table = conversations(spark)
    template = MarkedTurns()
    got = {r[0]: tuple(r)[1:] for r in read_back(format_conversations(table, template), template).collect()}
    assert got == wanted(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert read_back(format_conversations(empty, template), template).collect() == []


def test_blocks_hold_the_whole_rendering(spark, monkeypatch):
    rows, table = conversations(spark)
    blocks = format_conversations(table, MarkedTurns()).where("conv_id = 99").orderBy("block").collect()
    assert len(blocks) == -(-300 // chat.BLOCK_TURNS)
    want = MarkedTurns().render([("assistant" if i % 2 else "user", f"turn {i} <") for i in range(300)])
    assert "".join(b.formatted for b in blocks) == want


def test_spans_and_mask_of_a_template_that_is_not_read():
    turns = [("user", "<closing"), ("assistant", "</turn> #"), ("assistant", "")]
    template = MarkedTurns()
    got = locate(template, turns)
    assert got.text == template.render(turns) and not any(got.rewrites)
    assert [template.read(got.text[a:b])[0] for a, b in got.spans] == turns
    assert [m and template.unescape(got.text[m[0] : m[1]]) for m in got.loss] == [None, "</turn> #", ""]


def test_rewritten_history_is_found(spark):
    turns = [("user", "q"), ("assistant", "hm</think>a"), ("user", "r"), ("assistant", "so</think>b")]
    got = locate(drops_thoughts(), turns)
    assert got.rewrites == [False, False, True, False]
    table = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    row = format_conversations(table, drops_thoughts()).first()
    assert [t.rewrites for t in row.turns] == got.rewrites and row.formatted == got.text
