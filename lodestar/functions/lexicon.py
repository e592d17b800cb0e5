"""Fixed word lists of the default (Vietnamese) configuration, and the parameters of the filters."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

# Words that count as stop words in a sentence's density.
STOP_WORDS = (
    "và", "của", "là", "có", "được", "cho", "với", "từ", "trong", "ngoài", "trên", "dưới", "trước", "sau", "khi", "nếu", "thì",
    "mà", "nhưng", "hoặc", "vì", "do", "bởi", "tại", "theo", "qua", "bằng", "về", "đến", "này", "kia", "đó", "ấy", "nọ", "kìa",
    "đây", "đấy", "thế", "vậy", "rồi", "xong", "hết", "còn", "vẫn", "đang", "sẽ", "đã", "chưa", "không", "chẳng", "chả", "mới",
    "cũng",
)
# Phrases of contradiction by category.
CONTRADICTION = {
    "negation": ("không", "chẳng", "chả", "không phải", "không phải là"),
    "opposition": ("nhưng", "tuy nhiên", "mặc dù", "dù", "dù rằng"),
    "contrast": ("trái lại", "ngược lại", "thay vào đó", "thay thế"),
    "disagreement": ("sai", "không đúng", "không chính xác", "không phù hợp"),
}
# Endings of words that count as verbs.
VERB_ENDINGS = ("là", "có", "được", "cho", "với")
# Words of a claim that give no boost, and words of a sentence that give a special one.
BOOST_STOP = ("thay", "cách", "các", "để", "với", "của", "trong", "những", "được", "đang", "là", "có", "này", "cho", "từ", "một", "nhà", "như")
BOOST_SPECIAL = ("chim", "bird", "nghiên_cứu", "dạy", "giải_mã", "tiếng_anh", "công_nghệ", "giao_tiếp", "động_vật")
# Tags of words that become nodes.
POS_KEPT = ("N", "Np", "V", "A", "Nc", "M", "R", "P")
# Subjects that sentences should mention, in entities, as words of the claim, and as their beginnings.
SUBJECT_PARTS = ("chim", "bird", "vẹt", "đại bàng", "sếu", "peregrine")
SUBJECT_WORDS = ("bird", "parrot", "eagle", "sparrow")
SUBJECT_STARTS = ("chim",)
# Words that lead or extend a phrase, words that are no phrase, and tags that end one.
PHRASE_TITLES = ("cựu", "nguyên", "phó", "thứ", "đầu", "tiên", "chính", "trưởng")
PHRASE_STOP = ("là", "của", "và", "có", "trong", "để", "với", "từ", "này", "đó", "các", "một", "những")
PHRASE_BREAKS = ("CH", ".", ",", "!", "?", ";", ":")
# Patterns of phrases where there are no tags; what counts are their groups.
PHRASE_PATTERNS = (
    r"(cựu|nguyên|phó)\s+\w+(\s+\w+)*",
    r"[A-Z][a-z]+\s+[A-Z][a-z]+",
    r"\w+\s+(tổng thống|thủ tướng|chủ tịch|giám đốc)",
    r"(đầu tiên|cuối cùng|duy nhất)\s+\w+",
)


@dataclass(frozen=True)
class FilterConfig:
    """Thresholds of the cascade, clamped to their ranges."""

    min_quality: float = 0.3
    min_relevance: float = 0.15
    min_entity: float = 0.05
    min_entity_keep: int = 5
    max_final: int = 25
    bypass: float = 0.9
    support: float = 0.3
    refute: float = 0.7
    delta: float = 0.1
    stop_words: tuple[str, ...] = STOP_WORDS
    contradiction: dict[str, tuple[str, ...]] = field(default_factory=lambda: CONTRADICTION)

    def __post_init__(self) -> None:
        for name in ("min_quality", "min_relevance", "min_entity"):
            object.__setattr__(self, name, min(1.0, max(0.0, getattr(self, name))))
        object.__setattr__(self, "max_final", max(1, self.max_final))

    @classmethod
    def of(cls, settings: dict[str, str]) -> FilterConfig:
        """From settings by name, as of an environment or a session; unknown names and lists are left alone."""
        known = {f.name: type(getattr(cls(), f.name)) for f in fields(cls)}
        return cls(**{k: known[k](v) for k, v in settings.items() if known.get(k) in (int, float)})

    def relaxed(self) -> FilterConfig:
        """First-hop thresholds."""
        return replace(self, min_quality=max(0.1, self.min_quality - 0.2), min_relevance=max(0.05, self.min_relevance - 0.15))


@dataclass(frozen=True)
class SearchConfig:
    """Sizes of the search and of the hops, clamped to their ranges, and thresholds of similarity edges."""

    levels: int = 5
    per_level: int = 15
    width: int = 25
    depth: int = 80
    hops: int = 3
    hop_rows: int = 4
    similarity: float = 0.85
    neighbours: int = 5

    def __post_init__(self) -> None:
        for f in fields(self):
            if f.type == "int":
                object.__setattr__(self, f.name, max(1, getattr(self, f.name)))
        object.__setattr__(self, "similarity", min(1.0, max(0.0, self.similarity)))

    @classmethod
    def small(cls) -> SearchConfig:
        """For machines without an accelerator: fewer and closer neighbours."""
        return cls(similarity=0.9, neighbours=3)
