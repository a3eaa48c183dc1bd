"""Defaults of the engine. They decide results and equal those of the system that this engine stands in for."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Chunking:
    target_tokens: int = 512
    max_tokens: int = 768
    min_tokens: int = 80
    overlap_tokens: int = 64
    hard_boundary_level: int = 2
    prepend_breadcrumb: bool = True

    def __post_init__(self):
        if not self.overlap_tokens < self.target_tokens <= self.max_tokens:
            raise ValueError("needs overlap < target <= max")


@dataclass(frozen=True)
class Ocr:
    min_chars: int = 100
    alpha_ratio: float = 0.55
    cid_ratio: float = 0.01
    replacement_ratio: float = 0.02
    min_word_len: float = 1.5
    max_word_len: float = 20.0
    native_coverage: float = 0.80
    ocr_coverage: float = 0.20
    scanned_image_area: float = 0.85
    scanned_max_chars: int = 50
    max_ocr_pages: int = 500


@dataclass(frozen=True)
class Retrieval:
    rrf_k: int = 60
    vector_weight: float = 0.6
    keyword_weight: float = 0.4
    candidate_k: int = 50
    top_k: int = 8
    min_score: float = 0.0
    location_boost: float = 1.02
    dedup_threshold: float = 0.97


@dataclass(frozen=True)
class Context:
    budget_tokens: int = 4000
    tool_result_tokens: int = 1500
    reserve_tokens: int = 1024
    utilization: float = 0.75


@dataclass(frozen=True)
class Queue:
    visibility_ms: int = 300_000
    max_attempts: int = 3
    rate_per_minute: int = 60
    public_rate_per_minute: int = 20


#: Words that say nothing about a heading's topic. in/out/from/to stay: they tell check-in from check-out.
TOPIC_STOPWORDS = (
    "a an and the of for our your is are all policy policies information general section chapter overview about note notes detail details "
    "service services hour hours time times schedule schedules rule rules guideline guidelines procedure procedures requirement requirements "
    "fee fees charge charges terms condition conditions faq faqs guest guests"
).split()

#: Numbered headings: 3.2.1, IV., A), Chapter 5 and the like, and CJK articles.
NUMBERING = r"(?i)^\s*(?:\d+(?:\.\d+){0,3}[.)]?|[IVXLC]+[.)]|[A-Z][.)]|(?:Chapter|Section|Article|Appendix|Part)\s+[\dIVXLC]+|第\s*\d+\s*[条章節項])\s+\S"

#: What stands before the words of a heading: 3. or IV) or B., and Chapter 5: and the like.
HEADING_NUMBERS = (r"^\s*(?:\d+(?:\.\d+)*|[IVXLC]+|[A-Z])[.)]\s*", r"(?i)^\s*(?:Chapter|Section|Article|Appendix|Part)\s+[\dIVXLC]+[:.\s-]*")

#: Phrases that try to rewrite the prompt.
INJECTION = (
    r"(?i)\bignore\s+(?:all\s+|any\s+)?(?:previous|prior|above)\s+instructions?\b",
    r"(?i)\bdisregard\s+(?:the\s+)?(?:system|previous)\s+prompt\b",
    r"(?i)\byou\s+are\s+now\s+(?:a|an|in)\b.{0,40}\bmode\b",
    r"(?i)\breveal\s+(?:your\s+)?(?:system\s+prompt|instructions)\b",
    r"(?i)</?(?:system|instructions|sources?)\s*>",
)

HIGH_STAKES = ("legal", "hr", "safety", "compliance", "medical")
CHEAP_TASKS = ("classify", "rewrite", "title", "plan")
TIERS = ("fast", "balanced", "quality")
#: Stages of a job in order, with the share of the way that is done after each.
STAGES = {"UPLOADED": 0.05, "PARSING": 0.20, "OCR": 0.35, "CLEANING": 0.45, "CHUNKING": 0.55, "EMBEDDING": 0.80, "INDEXING": 0.90, "VALIDATING": 0.95, "ACTIVATING": 0.99, "COMPLETED": 1.0}
GATES = ("chunk_count", "content", "embeddings", "lexical_index", "tenant_isolation", "scope_consistency", "smoke_retrieval")
PRECEDENCE = {"ORGANIZATION": 0, "LOCATION": 100}
