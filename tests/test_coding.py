import random

from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.operators import coding as C


def greedy(text, symbols):
    taken, out = [False] * len(text), []
    for name, kind in sorted(symbols, key=lambda s: -len(s[0])):
        for at in range(len(text) - len(name) + 1):
            if text[at : at + len(name)] == name and not any(taken[at : at + len(name)]):
                out.append((name, kind))
                taken[at : at + len(name)] = [True] * len(name)
    return out


def test_symbols_longest_first(spark):
    rng = random.Random(1)
    symbols = [("ab", "x"), ("aba", "x"), ("ba", "y"), ("aa", "y"), ("bcab", "z"), ("水墨画", "art"), ("墨画", "art"), ("水", "art")]
    texts = ["".join(rng.choices("abc", k=rng.randrange(0, 25))) for _ in range(150)] + ["水墨画与水", "墨画水墨", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", C.symbol_matches(F.col("t"), symbols).alias("s")).collect():
        assert [tuple(x) for x in r.s] == greedy(r.t or "", symbols)


def test_codes_follow_the_rules(spark):
    book = C.Codebook(
        dimensions={"craft": ["good", "bad"], "view": ["watching"], "lore": ["compare", "fix"]},
        phrases={"good": ["精良"], "bad": ["出戏"], "watching": ["字幕", "画质"]},
        composed={"good": (["配乐", "打光"], ["好", "绝"], ["不好"])},
        suppressed={"watching": (["字幕好评"], ["字幕"])},
        patterns={"compare": [C.bounded_gap(["日本", "韩国"], ["不如", "一样"])], "fix": ["不是.{1,16}而是"]},
    )
    cases = {"配乐真好": ["good"], "配乐不好": [], "字幕好评": [], "字幕好评画质差": ["watching"], "日本也一样": ["compare"], "不是青铜而是铁": ["fix"], "日本一二三四五六七八九一样": [], "出戏，精良": ["good", "bad"], "  ": []}
    df = spark.createDataFrame([(t,) for t in cases] + [(None,)], "content string")
    for r in C.coded(df, book).collect():
        assert r.codes == cases.get(r.content, []), r.content
        assert r.dims == list(dict.fromkeys(book.dimension_of[c] for c in r.codes))


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


def fnv(t):
    v = 2166136261
    for c in t:
        v = (v ^ ord(c)) * 16777619 & 0xFFFFFFFF
    return v


def test_scalars(spark):
    c = F.col("t")
    for t in ("", "abc", "戏曲 x", "😀é"):
        assert one(spark, T.stable_hash(c), t=t) == fnv(t)
        x = "".join(t.split())
        want = list(dict.fromkeys(fnv(x[i : i + n]) % 32768 for n in (1, 2, 3) for i in range(len(x) - n + 1)))
        assert one(spark, T.feature_buckets(c), t=t) == want
    assert one(spark, T.normalize(c), t="a1 !戏_é") == "a1戏é"
    assert one(spark, T.compact(c), t="a　b \n") == "ab"
    assert one(spark, T.is_laugh(c, "哈h"), t="哈 h哈") and not one(spark, T.is_laugh(c, "哈h"), t="哈")
    assert one(spark, T.bigrams_of(c), t="水x墨 画") == ["水墨", "墨画"]
    assert one(spark, T.clean_title(c), t=" <em>a</em> &amp;lt; b ") == "a &lt; b"
    assert [one(spark, T.count_text(c), t=t) for t in ("1,234", "1.2万", "x", "", "7")] == [1234, 12000, 0, 0, 7]
    assert one(spark, T.video_number(c), t="BV1BK411L7DJ") == 497651138
    assert one(spark, T.remainder(c, F.array(F.lit("ab"), F.lit("abc"))), t="xabcyabz") == "xyz"
    assert one(spark, T.short_keys(c, ["吗", "是否"], ["老师"]), t="夜里下雨吗？老师是否带伞abc五个字的词一") == ["夜里下雨", "带伞"]
    assert one(spark, T.maximal_keys(c, ["茶", "绿茶", "杯子"]), t="杯子里的绿茶") == ["绿茶", "杯子"]
    assert one(spark, T.lead_in(c, F.col("u")), t="abcd", u="cdef") and not one(spark, T.lead_in(c, F.col("u")), t="abcd", u="dxyz")
    assert one(spark, T.absolute(F.lit("http://a.b/c/d.html?x"), c), t="../e") == "http://a.b/e"
    assert one(spark, T.absolute(F.lit("http://a.b/c/d.html?x"), c), t="/e") == "http://a.b/e"
    assert one(spark, T.post_number(c), t="http://a.b/post/4951.html?q=1") == 4951
    assert one(spark, T.is_asset(c), t="http://a.b/x.PDF?y") and not one(spark, T.is_asset(c), t="http://a.b/x.png")
    assert one(spark, T.file_name(c), t="http://a.b/%E8%8C%B6%E5%8D%95.pdf?y") == "茶单.pdf"
    assert one(spark, T.emails(c), t="b@x.org a@x.org b@x.org") == ["a@x.org", "b@x.org"]
    assert one(spark, T.labelled(c, ["电话"], "[0-9\\- ]{8,14}"), t="电话：010-1234567 \n") == ["010-1234567"]
    assert one(spark, T.norm_title(c, "^(【预告】)+", ["完整版"]), t="【预告】 “a”＋完整版") == "a+"
    assert one(spark, T.place_label(F.lit(0.1), F.lit(0.25)), t="") == "10%-25%"


def test_unescape_equals_the_standard_library(spark):
    import html

    texts = ["a", "&amp;lt;", "&#20013;&hellip;&middot;", "&#x4E2D;&#X41; &copy 2020", "&nosuch; &", "&#0;&#128;&#xD800;&#1114112;", "&NotEqualTilde;&lt&gt;", "&#99999999999999999999;", "x&y&z;", "&AMP;&quot;&#39;&apos;", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.unescape(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in rows} == {t: html.unescape(t) for t in texts}


def test_absolute_equals_the_standard_library(spark):
    from urllib.parse import urljoin

    bases = ["http://a.b/c/d.html?x=1#f", "http://a.b", "https://a.b/c/", "http://a.b/c/./d/../e?q"]
    refs = ["", "g", "./g", "g/", "/g", "//h/i", "?y", "g?y", "#s", "g#s", "..", "../", "../g", "../../g", "../../../g", "./../g", "g/./h", "g/../h", "g?y/../x", "/./g", "/../g", "http://z/y/../x", "mailto:a@b", ".", "a//b"]
    rows = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string").select("b", "r", T.absolute(F.col("b"), F.col("r")).alias("u")).collect()
    wrong = [(r.b, r.r, r.u, urljoin(r.b, r.r)) for r in rows if r.u != urljoin(r.b, r.r)]
    assert not wrong


def test_contacts(spark):
    c = T.contacts(F.col("t"), r"[0-9]{3}-[0-9]{4}", ["Host", "By"], "[A-Z][a-z]+", ["No"], "[0-9]+")
    r = one(spark, c, t="Host: Ann  By: Bob Host: Ann 555-1234 b@x.org No: 77 a@y.co.uk 555-1234")
    assert (r.emails, r.phones, r.numbers, r.organisers) == (["a@y.co.uk", "b@x.org"], ["555-1234"], ["77"], ["Ann", "Bob"])
