"""Perspectives against a plain rendering."""

from kinloom.llm import chat as C

ROWS = [
    (1, 0, "system", "Be kind"), (1, 1, "user", "Hi"), (1, 2, "assistant", "Hello <|im_end|> é"), (1, 3, "user", None), (1, 3, "user", None), (2, None, "bob", "x"), (2, 0, "eve", "y"), (2, 0, "ann", "z"), (2, 2000, "eve", "later"),
    (3, 0, "system", "alone"), (4, 0, None, "who"), (None, 1, "user", "no conversation"), (5, 0, "user", "w " * 50_000),
]


def _plain():
    out = {}
    said = sorted({(c, -1 if t is None else t // 1024, t, r or "unknown", (x or "").replace("<|", "< |")) for c, t, r, x in ROWS}, key=lambda x: (x[0] or -1, x[1], -1 if x[2] is None else x[2], *x[3:]))
    for c in {x[0] for x in said}:
        own = [x for x in said if x[0] == c]
        for speaker in {x[3] for x in own if x[3] != "system"} or {None}:
            for seg in {x[1] for x in own}:
                text, mask = "", []
                for _, s, _, role, body in own:
                    if s == seg:
                        text += C.START + ("assistant" if role == speaker else "system" if role == "system" else f"user name={role}") + "\n"
                        if role == speaker:
                            mask.append((len(text), len(text) + len(body + C.END) + 1))
                        text += body + C.END + "\n"
                out[c, seg, speaker] = (text, ",".join(f"{a}:{b}" for a, b in mask), sum(b - a for a, b in mask))
    return out


def test_rotate(spark):
    df = spark.createDataFrame([(*r, "m", 3) for r in ROWS], "conv_id long, turn long, role string, text string, mask string, turns int")
    got = C.rotate(df).collect()
    assert {(r.conv_id, r.segment, r.speaker): (r.rendered, r.mask, r.n_masked) for r in got} == _plain()
    assert len(got) == len(_plain())
    for r in got:
        for a, b in (map(int, x.split(":")) for x in r.mask.split(",") if x):
            assert r.rendered[a:b].endswith(C.END + "\n")
    assert C.rotate(df.limit(0)).count() == 0
