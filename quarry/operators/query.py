"""Query understanding: request checks, keyword paths, glossary, channels and arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import HAN, han_bigrams, trim_spaces

# The visual glossary, term and gloss.
GLOSSARY = [
    ("人", "person"), ("男人", "man"), ("女人", "woman"), ("孩子", "child"), ("婴儿", "baby"), ("人群", "crowd"), ("红色", "red"), ("蓝色", "blue"),
    ("绿色", "green"), ("黄色", "yellow"), ("黑色", "black"), ("白色", "white"), ("灰色", "gray"), ("棕色", "brown"), ("粉色", "pink"), ("紫色", "purple"),
    ("橙色", "orange"), ("厨房", "kitchen"), ("浴室", "bathroom"), ("卧室", "bedroom"), ("客厅", "living"), ("卫生间", "toilet"), ("阳台", "balcony"), ("办公室", "office"),
    ("教室", "classroom"), ("商店", "shop"), ("超市", "supermarket"), ("餐厅", "restaurant"), ("街道", "street"), ("马路", "road"), ("人行道", "sidewalk"), ("路边", "roadside"),
    ("公园", "park"), ("海滩", "beach"), ("沙滩", "beach"), ("山上", "mountain"), ("河边", "river"), ("湖边", "lake"), ("海边", "sea"), ("机场", "airport"),
    ("跑道", "runway"), ("车站", "station"), ("房间", "room"), ("室内", "indoor"), ("室外", "outdoor"), ("墙壁", "wall"), ("墙", "wall"), ("大门", "door"),
    ("窗户", "window"), ("地板", "floor"), ("天花板", "ceiling"), ("自行车", "bicycle"), ("汽车", "car"), ("轿车", "car"), ("公交车", "bus"), ("火车", "train"),
    ("飞机", "airplane"), ("客机", "airliner"), ("轮船", "ship"), ("小船", "boat"), ("船", "boat"), ("卡车", "truck"), ("摩托车", "motorcycle"), ("车", "car"),
    ("披萨", "pizza"), ("面包", "bread"), ("蛋糕", "cake"), ("苹果", "apple"), ("香蕉", "banana"), ("米饭", "rice"), ("咖啡", "coffee"), ("杯子", "cup"),
    ("瓶子", "bottle"), ("小狗", "dog"), ("小猫", "cat"), ("狗", "dog"), ("猫", "cat"), ("鸟", "bird"), ("马", "horse"), ("牛", "cow"),
    ("山羊", "goat"), ("羊", "sheep"), ("桌子", "table"), ("椅子", "chair"), ("沙发", "sofa"), ("床", "bed"), ("书", "book"), ("电脑", "computer"),
    ("手机", "phone"), ("书包", "backpack"), ("帽子", "hat"), ("鞋子", "shoe"), ("花朵", "flower"), ("树木", "tree"), ("树", "tree"), ("草地", "grass"),
    ("足球", "ball"), ("时钟", "clock"), ("台灯", "lamp"), ("淋浴", "shower"), ("花洒", "shower"), ("水槽", "sink"), ("镜子", "mirror"), ("毛巾", "towel"),
    ("长椅", "bench"), ("水面", "water"), ("桶", "bucket"), ("楼", "building"), ("文档", "document"), ("标题", "title"), ("页面", "page"), ("文字", "text"),
    ("图片", "picture"), ("版面", "layout"), ("坐着", "sitting"), ("站着", "standing"), ("走着", "walking"), ("吃着", "eating"), ("做饭", "cooking"), ("骑着", "riding"),
    ("停着", "parked"), ("停在", "parked"), ("破损", "broken"), ("破的", "broken"), ("大型", "large"), ("小型", "small"), ("顶部", "top"), ("一群", "group"),
]
CHANNELS = ("text", "keyword", "image")
ARMS = [("A0", ["keyword"], False), ("A1", ["text"], False), ("A2", ["image"], False), ("A3", ["text", "keyword"], False), ("A4", ["text", "keyword", "image"], False), ("A5", ["text", "keyword", "image"], True)]
FILE_TYPES = {"all": None, "text": [".txt", ".md"], "pdf": [".pdf"], "word": [".docx"], "image": [".jpg", ".jpeg", ".png"]}


def normalize_requests(requests: DataFrame) -> DataFrame:
    """requests (query, top_k, path_prefix, modified_after, file_type) with cleaned columns and `reason`, null where accepted."""
    query, raw = trim_spaces(F.coalesce("query", F.lit(""))), F.translate(F.trim(F.coalesce("path_prefix", F.lit(""))), "\\", "/")
    parts = F.filter(F.split(raw, "/"), lambda p: (p != "") & (p != "."))
    day = F.when(F.regexp_like("modified_after", F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), F.try_to_date("modified_after", "yyyy-MM-dd"))
    types = F.create_map(*[x for k, v in FILE_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.lit(None).cast("array<string>"))])
    kind = F.coalesce("file_type", F.lit("all"))
    reason = (
        F.when(query == "", "emptyQuery").when(~F.coalesce(F.col("top_k").between(1, 100), F.lit(False)), "topK")
        .when(raw.startswith("/") | raw.rlike("^[A-Za-z]:"), "absolutePath").when(F.array_contains(parts, ".."), "parentPath")
        .when(F.col("modified_after").isNotNull() & day.isNull(), "date").when(~kind.isin(*FILE_TYPES), "fileType")
    )
    return requests.withColumn("reason", reason).withColumn("clean_query", query).withColumn("clean_prefix", F.nullif(F.array_join(parts, "/"), F.lit(""))).withColumn("after_day", day).withColumn("extensions", F.try_element_at(types, kind))


def keyword_plan(queries: DataFrame) -> DataFrame:
    """Add terms and path: bigram if there are two-character terms, trigram from three characters on, else like."""
    terms = han_bigrams("query")
    path = F.when(F.size(terms) > 0, "bigram").when(F.char_length("query") >= 3, "trigram").otherwise("like")
    return queries.withColumn("terms", terms).withColumn("path", path)


def pieces(query: Column) -> Column:
    """array<struct<gloss, text>>: the longest glossary term at each place, else a Latin run of three letters or more."""
    longest_first = sorted((t for t, _ in GLOSSARY), key=lambda t: (-len(t), t))
    found = F.regexp_extract_all(query, F.lit(f"({'|'.join(longest_first)}|[A-Za-z]+)"), F.lit(1))
    lookup = F.create_map(*[F.lit(x) for pair in GLOSSARY for x in pair])
    gloss = F.transform(found, lambda p: F.struct(F.try_element_at(lookup, p).isNotNull().alias("gloss"), F.coalesce(F.try_element_at(lookup, p), p).alias("text")))
    return F.filter(gloss, lambda p: p["gloss"] | (F.char_length(p["text"]) >= 3))


def glossary_terms(queries: DataFrame) -> DataFrame:
    """Add glosses, latin_spans, probes (three characters or more) and clip_query, the rewritten image query."""
    out = queries.withColumn("_p", pieces(F.col("query")))
    texts = lambda keep: F.array_distinct(F.transform(F.filter("_p", keep), lambda p: p["text"]))
    out = out.withColumn("glosses", texts(lambda p: p["gloss"])).withColumn("latin_spans", texts(lambda p: ~p["gloss"])).withColumn("probes", texts(lambda p: F.char_length(p["text"]) >= 3))
    return out.withColumn("clip_query", F.when(F.size("glosses") > 0, F.array_join(texts(lambda p: F.lit(True)), " ")).otherwise(F.col("query"))).drop("_p")


def channel_availability(queries: DataFrame, text_budget: int = 128, image_budget: int = 77, image_ready: bool = True) -> DataFrame:
    """queries (requested, text_tokens, image_tokens) with channels and reason, null where the query can run."""
    asked = F.array_intersect("requested", F.array(*map(F.lit, CHANNELS)))
    no_image = (F.col("image_tokens") > image_budget) | F.lit(not image_ready)
    usable = F.when(no_image, F.array_except(asked, F.array(F.lit("image")))).otherwise(asked)
    reason = F.when(F.size(asked) == 0, "noChannel").when(F.array_contains(asked, "text") & (F.col("text_tokens") > text_budget), "overBudget").when(F.size(usable) == 0, "imageUnavailable")
    return queries.withColumn("channels", usable).withColumn("reason", reason)


def expand_arms(queries: DataFrame, arms: list[tuple[str, list[str], bool]] = ARMS) -> DataFrame:
    """Each query with each arm (arm, arm_channels, neighborhood)."""
    listed = F.array(*[F.struct(F.lit(a).alias("arm"), F.array(*map(F.lit, c)).alias("arm_channels"), F.lit(n).alias("neighborhood")) for a, c, n in arms])
    return queries.withColumn("_a", F.explode(listed)).select("*", "_a.*").drop("_a")


def has_han(c: Column | str) -> Column:
    return F.col(c).rlike(f"[{HAN}]") if isinstance(c, str) else c.rlike(f"[{HAN}]")
