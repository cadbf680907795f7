"""What questions ask for, which domain they are of, and short descriptions of jobs for the answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jobs import any_of, plain_number
from .text import let, squeeze, strip_marks

# Intents that may be stated, words that tell them, domains with their words and skills. Words count inside others too.
CAREER_INTENTS = ["score", "recommend", "improve_cv"]
GUEST_INTENTS = ["score", "recommend", "improve_cv", "general"]
CAREER_RECOMMEND = ["goi y", "recommend", "job", "cong viec"]
CAREER_IMPROVE = ["cai thien", "improve", "roadmap", "gap"]
GUEST_RECOMMEND = ["goi y", "gợi ý", "recommend", "job", "viec lam", "việc làm", "cong viec", "công việc", "ung tuyen", "ứng tuyển"]
GUEST_IMPROVE = ["cai thien", "cải thiện", "improve", "roadmap", "gap", "ky nang", "kỹ năng", "bo sung", "bổ sung"]
DOMAINS = {
    "DATA_AI": ["data", "ai", "machine learning", "ml", "analytics", "python", "bigdata", "spark", "hadoop"],
    "WEB": ["web", "react", "vue", "angular", "nodejs", "frontend", "backend", "javascript", "typescript"],
    "MOBILE": ["mobile", "ios", "android", "flutter", "react native", "xamarin"],
    "DEVOPS": ["devops", "kubernetes", "docker", "cloud", "aws", "azure", "ci/cd", "jenkins"],
    "BACKEND": ["java", "spring", "enterprise", ".net", "c#"],
}
DOMAIN_SKILLS = {
    "DATA_AI": ["python", "sql", "machine learning", "pandas", "numpy", "scikit-learn", "tensorflow", "pytorch", "spark", "analytics", "statistics"],
    "WEB": ["react", "vue", "angular", "nodejs", "javascript", "typescript", "html", "css", "webpack", "api", "rest"],
    "MOBILE": ["ios", "android", "swift", "kotlin", "flutter", "react native", "mobile", "ui/ux"],
    "DEVOPS": ["docker", "kubernetes", "aws", "azure", "ci/cd", "jenkins", "terraform", "monitoring", "linux"],
    "BACKEND": ["java", "spring", "sql", "rest", "microservices", ".net", "enterprise", "architecture"],
}
NO_DESCRIPTION = "Chưa có mô tả chi tiết."


def _stated(intent: Column, allowed: list[str]) -> Column:
    plain = F.lower(F.trim(F.coalesce(intent, F.lit(""))))
    return F.when(plain.isin(*allowed), plain)


def _lowered(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x, F.lit(""))))


def career_intent(stated: Column, question: Column) -> Column:
    """The stated intent if it is one, else recommend, improve_cv or score by the question's words; a recommendation goes first."""
    told = let(_lowered(question), lambda q: F.when(any_of(q, CAREER_RECOMMEND), "recommend").when(any_of(q, CAREER_IMPROVE), "improve_cv").otherwise("score"))
    return F.coalesce(_stated(stated, CAREER_INTENTS), told)


def guest_intent(stated: Column, question: Column, guessed: Column | None = None) -> Column:
    """The stated intent, else the one guessed by a model, else improve_cv, recommend or general by the question's words with and without
    accents. Words for scores deliberately mean general."""
    both = let(_lowered(question), lambda q: F.concat(q, F.lit(" "), squeeze(strip_marks(q))))
    told = let(both, lambda q: F.when(any_of(q, GUEST_IMPROVE), "improve_cv").when(any_of(q, GUEST_RECOMMEND), "recommend").otherwise("general"))
    known = [_stated(stated, GUEST_INTENTS), *([_stated(guessed, GUEST_INTENTS)] if guessed is not None else [])]
    return F.coalesce(*known, told)


def domain(question: Column) -> Column:
    """The first domain one of whose words is in a text, GENERAL without any."""

    def first(q: Column) -> Column:
        out = F.lit("GENERAL")
        for name, words in reversed(DOMAINS.items()):
            out = F.when(any_of(q, words), name).otherwise(out)
        return out

    return let(_lowered(question), first)


def skills_of_domain_first(skills: Column, name: Column) -> Column:
    """Skills that contain a word of the domain first, otherwise in their order; as they are for GENERAL."""
    has = lambda words: lambda s: any_of(F.lower(s), words)
    lacks = lambda words: lambda s: ~any_of(F.lower(s), words)
    out = skills
    for of, words in DOMAIN_SKILLS.items():
        out = F.when(name == of, F.concat(F.filter(skills, has(words)), F.filter(skills, lacks(words)))).otherwise(out)
    return out


def quantity(requirements: Column) -> Column:
    """What a text says about how many are wanted; empty without it."""
    return F.trim(F.regexp_extract(squeeze(F.coalesce(requirements, F.lit(""))), r"(?iu)s[oố]\s*l[uư][oợ]ng\s*tuy[eể]n\s*[:\-]?\s*([^.;,\n]+)", 1))


def job_description(requirements: Column, low: Column, high: Column) -> Column:
    """Experience, quantity and the first 220 characters of the requirements between bars; a fixed sentence without any."""
    text = squeeze(F.coalesce(requirements, F.lit("")))
    n = plain_number
    years = (
        F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit("Kinh nghiệm: "), n(low), F.lit("-"), n(high), F.lit(" năm")))
        .when(low.isNotNull(), F.concat(F.lit("Kinh nghiệm tối thiểu: "), n(low), F.lit(" năm"))).when(high.isNotNull(), F.concat(F.lit("Kinh nghiệm tối đa: "), n(high), F.lit(" năm")))
    )
    short = F.when(F.length(text) > 220, F.concat(F.left(text, F.lit(220)), F.lit("..."))).when(text != "", text)
    wanted = F.when(quantity(requirements) != "", F.concat(F.lit("Số lượng tuyển: "), quantity(requirements)))
    return F.coalesce(F.nullif(F.concat_ws(" | ", years, wanted, short), F.lit("")), F.lit(NO_DESCRIPTION))
