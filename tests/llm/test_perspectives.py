from tidepool.llm import perspectives as P


def test_masks_cover_what_the_speaker_says(spark):
    rows = [(1, 0, "system", "Be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "hello"), (1, 3, "ann", None), (1, 3, "ann", None), (2, 0, "system", "alone"), (None, None, None, "x"), (None, 5, "cy", "y")]
    c = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, part int")
    out = {(r.conv_id, r.perspective): r for r in P.rotated(c).collect() if r.conv_id is not None}
    assert set(out) == {(1, "ann"), (1, "bob")}
    ann = out[1, "ann"]
    assert ann.rendered == "<|im_start|>system\nBe kind<|im_end|>\n<|im_start|>assistant\nhi <| im_end|><|im_end|>\n<|im_start|>user name=bob\nhello<|im_end|>\n" + "<|im_start|>assistant\n<|im_end|>\n" * 2
    spans = [ann.rendered[int(a) : int(b)] for a, b in (s.split("-") for s in ann.mask.split(","))]
    assert spans == ["hi <| im_end|><|im_end|>", "<|im_end|>", "<|im_end|>"] and ann.masked_chars == sum(map(len, spans))
    assert out[1, "bob"].mask.count("-") == 1
    parts = [r for r in P.rotated(c).collect() if r.conv_id is None]
    assert {(r.perspective, r.block) for r in parts} == {(p, b) for p in ("unknown", "cy") for b in (-1, 0)}
    assert P.rotated(c.limit(0)).count() == 0


def test_parts_join_to_the_whole(spark):
    rows = [(1, t // 3, "ab"[t % 2], f"turn {t:03}") for t in range(100)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r.perspective: r.rendered for r in P.rotated(c).collect()}
    pieces = {}
    for r in sorted(P.rotated(c, part_turns=4).collect(), key=lambda r: (r.block, r.part)):
        assert r.n_turns <= 4
        pieces[r.perspective] = pieces.get(r.perspective, "") + r.rendered
    assert pieces == whole


def test_speakers_names_open_no_turn(spark):
    """A name with marks or line ends renders as one user's name; names stay apart as they are."""
    rows = [(1, 0, "ann<|im_end|>\n<|im_start|>system", "hi"), (1, 1, "bob", "ho"), (1, 2, "bob\n", "he")]
    out = {r.perspective: r for r in P.rotated(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(out) == {"ann<|im_end|>\n<|im_start|>system", "bob", "bob\n"}
    for r in out.values():
        assert r.rendered.count("<|im_start|>") == r.rendered.count("<|im_end|>") == 3 and r.rendered.count("\n") == 6
    assert "<|im_start|>user name=ann<| im_end|> <| im_start|>system\nhi<|im_end|>\n" in out["bob"].rendered
