"""Word lists, patterns and constants that results depend on."""

CN_NUMERAL = "一二三四五六七八九十百千万零〇两0-9"
CHAPTER_PATTERNS = (rf"第[{CN_NUMERAL}]+章", rf"[{CN_NUMERAL}]+章", r"Chapter\s+[0-9]+", r"【 第 [0-9]+ 部分 】")
REAL_CHAPTER = rf"(?iU)^(?:第[{CN_NUMERAL}]+章|[{CN_NUMERAL}]+章|Chapter\s+[0-9]+)\b"
AD_LINE_STARTS = ("本书来自", "更多精彩", "请收藏", "最新网址", "手机用户请浏览", r"www\.", "http://", "https://")

QUERY_ROUTES = {
    "character_relation": ("关系", "人物", "角色", "主角", "同伴", "敌人", "relationship", "character"),
    "faction_history": ("势力", "国家", "家族", "组织", "派系", "历史", "faction", "kingdom", "family"),
    "location": ("地点", "地理", "城市", "大陆", "地图", "遗迹", "location", "place", "map"),
    "power_system": ("力量", "魔法", "法师", "能力", "规则", "体系", "power", "magic"),
    "timeline": ("时间线", "演变", "变化", "变迁", "先后", "timeline", "chronology"),
}
CLUSTER_TYPE_HINTS = {
    "character_relation": ("character",),
    "faction_history": ("faction", "history"),
    "location": ("location",),
    "power_system": ("power_system",),
    "timeline": ("history",),
}
CLUSTER_TYPE_LABELS = {"character": "角色关系", "faction": "核心势力", "location": "关键地点", "power_system": "力量体系", "history": "历史事件", "mystery": "悬疑异常"}
CLUSTER_WORDS = {
    "location": ("地点", "地理", "城堡", "遗迹"),
    "faction": ("势力", "家族", "王国", "贵族"),
    "power_system": ("魔法", "能力", "规则", "精神"),
    "mystery": ("异常", "伏笔", "秘密", "谜"),
}
HISTORY_WORDS = ("历史", "事件", "战争")
CENTER_SPAN_TYPES = {
    "character": ("interaction", "reflection"),
    "faction": ("exposition",),
    "location": ("exposition",),
    "power_system": ("exposition", "reflection"),
    "history": ("progression", "transition", "mixed"),
    "mystery": ("exposition", "reflection"),
}
ENTITY_WORDS = {
    "faction": ("家族", "帝国", "王国", "领", "组织", "骑士团", "教会"),
    "location": ("领", "城堡", "隧道", "大陆", "塔", "遗迹", "营地", "陵寝", "山", "河"),
    "character": ("·",),
}
GRAPH_WEIGHTS = {"vector": 0.4, "entity": 0.35, "bm25": 0.1, "chapter": 0.1, "salience": 0.05}
SPAN_TYPES = ("progression", "exposition", "interaction", "reflection", "transition", "mixed", "other")

CLOSING_MARKS = ("”", "’", "」", "』", "）", ")", "，", "。", "！", "？", "、", "；", "：")
OPENING_MARKS = ("“", "‘", "「", "『", "（", "(")
MATCH_REPLACEMENTS = {"“": '"', "”": '"', "‘": "'", "’": "'", "…": ".", "　": " "}

CUTOFFS = (1, 3, 5, 10, 20)
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
