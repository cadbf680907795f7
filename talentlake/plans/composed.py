"""Rules for job ads on texts composed from the given tables, with twins that work the answer out from the columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import build, jobs, questions, scores, text
from ..operators import refdata
from .base import Registry, spread, table

R = Registry()


def _s(c: Column) -> Column:
    return c.cast("string")


def _by_case(k: Column, *forms: Column) -> Column:
    """The form of a row by the rest of its key."""
    out = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        out = F.when(k % len(forms) == i, form).otherwise(out)
    return out


@R.add("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_brand || '/' || p_type WHEN 1 THEN p_name || '/' || p_type || '/' || p_brand WHEN 2 THEN p_name || '/' || p_brand WHEN 3 THEN p_name WHEN 4 THEN ''
                 WHEN 5 THEN '[' || p_name ELSE p_type || '/' || p_brand END AS items FROM part""")
def parse_lists(spark, sf):
    """Lists from JSON lists, JSON objects, texts with bars or commas, single and broken values."""
    p, q = table(spark, sf, "part"), F.lit('"')
    forms = (
        F.concat(F.lit('["'), "p_brand", F.lit('", "'), "p_type", F.lit(' ", ""]')), F.concat_ws("|", F.concat("p_name", F.lit(" ")), "p_type", "p_brand"), F.concat("p_name", F.lit(", "), "p_brand"), F.col("p_name"),
        F.lit(" "), F.concat(F.lit("["), "p_name"), F.concat(F.lit('{"k": "'), "p_type", F.lit('", "m": '), q, "p_brand", F.lit('"}')),
    )
    return p.select("p_partkey", F.array_join(text.parse_list(_by_case(F.col("p_partkey"), *forms)), "/").alias("items"))


_PAY_BUCKET = "CASE WHEN v IS NULL THEN 'unknown' WHEN v < 10000000 THEN 'under_10m' WHEN v < 20000000 THEN '10m_20m' WHEN v < 30000000 THEN '20m_30m' WHEN v < 50000000 THEN '30m_50m' ELSE '50m_plus' END"


@R.add(f"""WITH p AS (SELECT o_orderkey, o_orderkey % 9 AS c, (o_custkey % 40 + 3)::DOUBLE AS n FROM orders),
           r AS (SELECT o_orderkey, CASE WHEN c IN (0, 2, 4) THEN 'range' WHEN c = 1 THEN 'negotiable' WHEN c = 3 THEN 'upper_bound' WHEN c IN (5, 6, 8) THEN 'fixed' ELSE 'unknown' END AS type,
                   CASE WHEN c <> 7 THEN c = 1 END AS negotiable,
                   CASE c WHEN 0 THEN n * 1e6 WHEN 2 THEN n * 1000 * 25000 WHEN 4 THEN n * 1000000 WHEN 5 THEN n * 1e6 WHEN 6 THEN n * 1000 WHEN 8 THEN (n + 0.5) * 1e6 END AS low,
                   CASE c WHEN 0 THEN (n + 10) * 1e6 WHEN 2 THEN (n * 1000 + 500) * 25000 WHEN 3 THEN n * 100 * 25000 WHEN 4 THEN (n + 2) * 1000000 WHEN 5 THEN n * 1e6 WHEN 6 THEN n * 1000 WHEN 8 THEN (n + 0.5) * 1e6 END AS high FROM p)
           SELECT o_orderkey, type, negotiable, round(low, 3) AS low, round(high, 3) AS high, CASE WHEN negotiable THEN 'negotiable' ELSE {_PAY_BUCKET} END AS bucket FROM (SELECT *, coalesce(high, low) AS v FROM r)""")
def parse_pay(spark, sf):
    """Pay in millions, thousands and dollars, with separators, open and unknown."""
    n = F.col("n")
    grouped = lambda v: F.format_number(v, 0)
    forms = (
        F.concat(_s(n), F.lit(" - "), _s(n + 10), F.lit(" triệu")), F.lit("Thỏa thuận"), F.concat(grouped(n * 1000), F.lit(" - "), grouped(n * 1000 + 500), F.lit(" USD")), F.concat(F.lit("Up to "), _s(n * 100), F.lit("$")),
        F.concat(grouped(n * 1000000), F.lit(" - "), F.translate(grouped((n + 2) * 1000000), ",", ".")), F.concat(F.lit("Từ "), _s(n), F.lit(" triệu")), F.concat(_s(n), F.lit("k")), F.lit("không rõ"), F.concat(_s(n), F.lit(".5 triệu")),
    )
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 40 + 3).cast("int").alias("n"))
    out = o.select("o_orderkey", jobs.parse_pay(_by_case(F.col("o_orderkey"), *forms)).alias("p"))
    return out.select("o_orderkey", "p.type", "p.negotiable", F.round("p.low", 3).alias("low"), F.round("p.high", 3).alias("high"), "p.bucket")


@R.add("""WITH p AS (SELECT p_partkey, p_partkey % 10 AS c, (p_size % 9 + 1)::DOUBLE AS n FROM part)
          SELECT p_partkey, round(CASE WHEN c IN (6, 9) OR c = 5 THEN 0 WHEN c = 0 THEN n / 12 WHEN c = 8 THEN NULL WHEN c = 7 THEN n / 12 ELSE n END, 6) AS low,
                 round(CASE WHEN c IN (6, 9) THEN 0 WHEN c = 0 THEN n WHEN c IN (1, 2) THEN n + 1 WHEN c = 5 THEN n WHEN c = 7 THEN n / 12 END, 6) AS high,
                 CASE WHEN c IN (0, 1, 2) THEN 'range' WHEN c IN (3, 4) THEN 'minimum' WHEN c = 5 THEN 'maximum' WHEN c IN (6, 9) THEN 'no_experience' WHEN c = 7 THEN 'fixed' ELSE 'unknown' END AS type FROM p""")
def parse_experience(spark, sf):
    """Years and months: ranges, least and most, none, and what says nothing."""
    n = F.col("n")
    forms = (
        F.concat(_s(n), F.lit(" tháng - "), _s(n), F.lit(" năm")), F.concat(_s(n), F.lit("-"), _s(n + 1), F.lit(" năm")), F.concat(F.lit("từ "), _s(n), F.lit(" đến "), _s(n + 1), F.lit(" năm")), F.concat(F.lit("trên "), _s(n), F.lit(" năm")),
        F.concat(_s(n), F.lit("+ years")), F.concat(F.lit("dưới "), _s(n), F.lit(" năm")), F.lit("Không yêu cầu kinh nghiệm"), F.concat(_s(n), F.lit(" months")), F.lit(""), F.lit("No experience"),
    )
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 9 + 1).cast("int").alias("n"))
    out = p.select("p_partkey", jobs.parse_experience(_by_case(F.col("p_partkey"), *forms)).alias("e"))
    return out.select("p_partkey", F.round("e.low", 6).alias("low"), F.round("e.high", 6).alias("high"), "e.type")


@R.add("""WITH d AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN (o_orderdate + INTERVAL 4 YEAR)::DATE WHEN 2 THEN DATE '1999-06-15' + (o_custkey % 60)::INT END AS date,
                 CASE o_orderkey % 5 WHEN 0 THEN 'date' WHEN 1 THEN 'date' WHEN 2 THEN 'relative_days' ELSE 'unknown' END AS type
          FROM (SELECT o_orderkey, o_custkey, CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate END AS o_orderdate FROM orders))
          SELECT o_orderkey, date, datediff('day', DATE '1999-06-15', date)::INTEGER AS days, type, date < DATE '1999-06-15' AS expired FROM d""")
def parse_deadline(spark, sf):
    """Dates with two and four digits of the year, days from a given day, and dates that do not exist."""
    o = table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))
    d = F.when((F.month("d") == 2) & (F.dayofmonth("d") == 29), F.date_sub("d", 1)).otherwise(F.col("d"))
    shifted = F.add_months(d, 48)  # two digits are of this century
    forms = (
        F.concat(F.lit("Hạn nộp: "), F.date_format(d, "dd/MM/yyyy")), F.when(F.year(shifted) >= 2000, F.date_format(shifted, "d-M-yy")).otherwise(F.date_format(shifted, "d-M-yyyy")),
        F.concat(F.lit("còn "), _s(F.col("o_custkey") % 60), F.lit(" ngày")), F.concat(F.lit("31/02/"), _s(F.year(d))), F.lit(""),
    )
    out = o.select("o_orderkey", jobs.parse_deadline(_by_case(F.col("o_orderkey"), *forms), F.to_date(F.lit("1999-06-15"))).alias("p"))
    return out.select("o_orderkey", "p.date", "p.days", "p.type", "p.expired")


@R.add("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'senior' WHEN 1 THEN 'manager' WHEN 2 THEN 'junior' ELSE 'unknown' END AS level,
                 CASE p_size % 5 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' WHEN 3 THEN 'hybrid' ELSE 'unknown' END AS mode,
                 CASE p_size % 5 WHEN 0 THEN 'work from home' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'lam viec tai cong ty' WHEN 3 THEN 'remote ' || p_size || ' days/month' END AS mode_source,
                 CASE p_partkey % 3 WHEN 0 THEN 'master' WHEN 1 THEN 'college' ELSE 'unknown' END AS education,
                 CASE p_size % 4 WHEN 0 THEN 'full_time' WHEN 1 THEN 'internship' WHEN 2 THEN 'freelance' ELSE 'unknown' END AS employment FROM part""")
def job_rules(spark, sf):
    """Level, work mode and what decided it, education and employment of composed ads."""
    p, k, n = spread(table(spark, sf, "part").select("p_partkey", "p_size", "p_name", "p_type", "p_brand")), F.col("p_partkey"), F.col("p_size")
    title = _by_case(k, F.concat(F.lit("Senior "), "p_name"), F.concat(F.lit("Trưởng phòng "), "p_name"), F.concat(F.lit("Nhân viên "), "p_name"), F.col("p_name"))
    mode = _by_case(n, F.lit("Work from home"), F.lit("Hybrid"), F.lit("làm việc tại công ty"), F.concat(F.lit("remote "), _s(n), F.lit(" days/month")), F.col("p_type"))
    education = _by_case(k, F.lit("Tốt nghiệp đại học, ưu tiên thạc sĩ"), F.lit("Cao đẳng"), F.col("p_brand"))
    employment = _by_case(n, F.lit("Full-time"), F.lit("Thực tập sinh"), F.lit("Cộng tác viên"), F.col("p_type"))
    return p.select("p_partkey", jobs.level_from_text(title).alias("level"), jobs.work_mode(mode).alias("mode"), jobs.work_mode_source(mode).alias("mode_source"), jobs.education_level(education).alias("education"), jobs.employment_type(employment).alias("employment"))


@R.add("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Ha Noi, Da Nang' WHEN 1 THEN 'Ho Chi Minh' WHEN 3 THEN 'Berlin, Paris' END AS city, s_suppkey % 4 IN (0, 3) AS is_multi,
                 CASE s_suppkey % 4 WHEN 0 THEN 'Hà Nội: 12 ' || s_name || ' | Đà Nẵng: 3 ' || s_nationkey WHEN 1 THEN 'TPHCM: ' || s_name ELSE '' END AS parts FROM supplier""")
def city_detect(spark, sf):
    """Cities and address parts of composed addresses."""
    name = F.col("s_name")
    forms = (
        F.concat(F.lit("Hà Nội: 12 "), name, F.lit("; Đà Nẵng: 3 "), _s(F.col("s_nationkey")), F.lit(" và 2 địa điểm khác")), F.concat(F.lit("TPHCM: "), name), name, F.concat(F.lit("Offices in Berlin and Paris, "), name),
    )
    out = table(spark, sf, "supplier").select("s_suppkey", jobs.parse_address(_by_case(F.col("s_suppkey"), *forms)).alias("a"))
    return out.select("s_suppkey", "a.city", "a.is_multi", F.col("a.text").alias("parts"))


_BAG = "len(list_filter(range(1, len({a}) + 1), lambda i: len(list_filter({a}[1:i], lambda x: x = {a}[i])) <= len(list_filter({b}, lambda x: x = {a}[i]))))"
_PAIRS = "list_transform(range(1, len({a})), lambda i: {a}[i] || ' ' || {a}[i + 1])"


@R.add(f"""WITH w AS (SELECT p_partkey, p_partkey % 4 AS c, string_split(p_name || ' of ' || lower(p_type), ' ') AS t, split_part(p_name, ' ', 1) AS x, split_part(p_name, ' ', 2) AS y, lower(p_type) AS z FROM part),
           a AS (SELECT *, CASE c WHEN 0 THEN t WHEN 1 THEN [x, y, 'of'] WHEN 2 THEN [x, 'old', 'of', z] ELSE ['none'] END AS a FROM w),
           b AS (SELECT *, {_PAIRS.format(a="a")} AS ab, {_PAIRS.format(a="t")} AS tb FROM a),
           n AS (SELECT *, {_BAG.format(a="a", b="t")}::DOUBLE AS m, {_BAG.format(a="ab", b="tb")}::DOUBLE AS mb, CASE c WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 3 ELSE 0 END::DOUBLE AS lcs FROM b)
           SELECT p_partkey, (c = 0)::INTEGER AS exact, round(2 * m / (len(a) + len(t)), 6) AS f1, round(2 * lcs / (len(a) + len(t)), 6) AS rouge,
                  round(CASE WHEN m = 0 OR mb = 0 THEN 0 ELSE sqrt(m / len(a) * (mb / greatest(len(ab), 1))) * CASE WHEN len(a) < len(t) THEN exp(1 - len(t)::DOUBLE / len(a)) ELSE 1 END END, 6) AS bleu,
                  (list_contains(a, y) AND list_contains(a, x))::INTEGER AS keywords FROM n""")
def answer_metrics(spark, sf):
    """Exact match, token F1, ROUGE-L, BLEU-2 and keyword accuracy of answers: whole, cut short, with a wrong word, wrong."""
    x, y, z = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lower("p_type")
    truth = F.concat("p_name", F.lit(" of "), z)
    answer = _by_case(F.col("p_partkey"), truth, F.concat("p_name", F.lit(" of")), F.concat_ws(" ", x, F.lit("old"), F.lit("of"), z), F.lit("none"))
    p = spread(table(spark, sf, "part").select("p_partkey", "p_name", "p_type")).select("p_partkey", answer.alias("a"), truth.alias("t"), F.array(x, y).alias("k"))
    r = lambda c: F.round(c, 6)
    a, t = F.col("a"), F.col("t")
    return p.select("p_partkey", (a == t).cast("int").alias("exact"), r(scores.token_f1(a, t)).alias("f1"), r(scores.rouge_l(a, t)).alias("rouge"), r(scores.bleu_2(a, t)).alias("bleu"), scores.keyword_accuracy(a, F.col("k"), 0.67).alias("keywords"))


@R.add("""SELECT o_orderkey, CASE WHEN c = 0 THEN format('{:,}', n * 1000000) || ' - ' || format('{:,}', (n + 5) * 1000000) WHEN c = 1 THEN 'up to ' || format('{:,}', n * 1000000) WHEN c = 2 THEN 'from ' || n ELSE format('{:,}', n * 1000000) END AS pay,
                 CASE WHEN c = 0 THEN n || '.5-' || (n + 1) || ' years' WHEN c = 1 THEN 'no experience required' WHEN c = 2 THEN 'from ' || n || ' years' ELSE n || ' years' END AS experience,
                 CASE WHEN c = 0 THEN n || ' years' WHEN c = 1 THEN 'No requirement' WHEN c = 2 THEN '<1 year' ELSE o_orderpriority END AS pattern,
                 CASE WHEN c = 0 THEN n WHEN c IN (1, 2) THEN CASE WHEN c = 2 THEN 1 ELSE 0 END ELSE left(o_orderpriority, 1)::BIGINT END::DOUBLE AS number,
                 CASE WHEN c = 0 THEN n END::INTEGER AS heads
          FROM (SELECT o_orderkey, o_orderpriority, o_orderkey % 4 AS c, (o_custkey % 30 + 2)::BIGINT AS n FROM orders)""")
def briefs(spark, sf):
    """Short forms of pay and experience, profile patterns, numbers and headcounts."""
    k, n = F.col("o_orderkey") % 4, F.col("n")
    d = n.cast("double")
    low = F.when(k == 0, d * 1000000).when(k == 2, d).when(k == 3, d * 1000000)
    high = F.when(k == 0, (d + 5) * 1000000).when(k.isin(1, 3), d * 1000000)
    least = F.when(k == 0, d + 0.5).when(k == 1, 0.0).otherwise(d)
    most = F.when(k == 0, d + 1).when(k == 1, 0.0).when(k == 3, d)
    said = _by_case(F.col("o_orderkey"), F.concat(_s(n), F.lit(" năm")), F.lit("No experience"), F.lit("dưới 1 năm"), F.col("o_orderpriority"))
    asked = F.when(k == 0, F.concat(F.lit("Tuyển "), _s(n), F.lit(" người"))).otherwise("")
    o = table(spark, sf, "orders").withColumn("n", (F.col("o_custkey") % 30 + 2).cast("int"))
    return o.select("o_orderkey", jobs.pay_brief(low, high).alias("pay"), jobs.experience_brief(least, most).alias("experience"), jobs.experience_pattern(said).alias("pattern"), jobs.years_number(said).alias("number"), build.headcount(asked).alias("heads"))


@R.add("""WITH j AS (SELECT p_partkey AS job_id, row_number() OVER (ORDER BY p_partkey) - 1 AS place, count(*) OVER () AS n FROM part),
          c AS (SELECT c_custkey AS cv_id, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer)
          SELECT cv_id, job_id FROM (SELECT cv_id, (c.place * 10 + i) % (SELECT max(n) FROM j) AS place FROM c, range(10) t(i)) JOIN j USING (place)""")
def pair_template(spark, sf):
    """Pairs to judge: ten jobs for each cv, going round all jobs."""
    return refdata.template(table(spark, sf, "customer").select(F.col("c_custkey").alias("cv_id")), table(spark, sf, "part").select(F.col("p_partkey").alias("job_id")), 10)


_ASKED = """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN ' Score' WHEN 1 THEN '' WHEN 3 THEN 'other' END AS stated, CASE conv_id % 5 WHEN 0 THEN 'general' WHEN 1 THEN 'none' END AS guessed,
            CASE conv_id % 7 WHEN 0 THEN 'Gợi ý việc làm' WHEN 1 THEN 'Cải thiện CV' WHEN 2 THEN 'Chấm điểm' WHEN 3 THEN 'A JOB in Spark' WHEN 4 THEN 'React Native roadmap' WHEN 5 THEN 'Kỹ năng C# và .NET' ELSE role END AS q FROM conversations"""


@R.add(f"""SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'score' WHEN conv_id % 7 = 3 THEN 'recommend' WHEN conv_id % 7 = 4 THEN 'improve_cv' ELSE 'score' END AS career,
                  CASE WHEN turn % 4 = 0 THEN 'score' WHEN guessed = 'general' THEN 'general' WHEN regexp_matches(strip_accents(lower(q)), 'cai thien|roadmap|ky nang') THEN 'improve_cv' WHEN regexp_matches(strip_accents(lower(q)), 'goi y|viec lam|job') THEN 'recommend' ELSE 'general' END AS guest,
                  CASE WHEN contains(lower(q), 'spark') OR contains(lower(q), 'ai') THEN 'DATA_AI' WHEN contains(lower(q), 'react') THEN 'WEB' WHEN contains(lower(q), 'c#') THEN 'BACKEND' ELSE 'GENERAL' END AS domain,
                  CASE WHEN contains(lower(q), 'spark') THEN 'SQL,spark sql,java,react' WHEN contains(lower(q), 'react') THEN 'react,java,SQL,spark sql' WHEN contains(lower(q), 'c#') THEN 'java,SQL,spark sql,react' ELSE 'java,SQL,react,spark sql' END AS ordered
           FROM ({_ASKED})""")
def question_routing(spark, sf):
    """Intents by both classifiers, the domain of composed questions, and skills in its order."""
    k, t = F.col("conv_id") % 7, F.col("turn") % 4
    q = F.when(k == 0, "Gợi ý việc làm").when(k == 1, "Cải thiện CV").when(k == 2, "Chấm điểm").when(k == 3, "A JOB in Spark").when(k == 4, "React Native roadmap").when(k == 5, "Kỹ năng C# và .NET").otherwise(F.col("role"))
    stated, guessed = F.when(t == 0, " Score").when(t == 1, "").when(t == 3, "other"), F.when(F.col("conv_id") % 5 == 0, "general").when(F.col("conv_id") % 5 == 1, "none")
    owned = F.array(*[F.lit(s) for s in ("java", "SQL", "react", "spark sql")])
    c = table(spark, sf, "conversations").select("conv_id", "turn", questions.career_intent(stated, q).alias("career"), questions.guest_intent(stated, q, guessed).alias("guest"), questions.domain(q).alias("domain"))
    return c.withColumn("ordered", F.array_join(questions.skills_of_domain_first(owned, F.col("domain")), ","))


@R.add("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'Chưa có mô tả chi tiết.' ELSE concat_ws(' | ', years, CASE WHEN o_orderkey % 3 = 0 THEN 'Số lượng tuyển: ' || n || ' người' END,
                 CASE WHEN length(req) > 220 THEN left(req, 220) || '...' ELSE req END) END AS description
          FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'Kinh nghiệm: ' || n || '-' || (n + 1) || '.5 năm' WHEN 1 THEN 'Kinh nghiệm tối thiểu: ' || n || ' năm' WHEN 2 THEN 'Kinh nghiệm tối đa: ' || (n + 1) || '.5 năm' END AS years,
                  CASE WHEN o_orderkey % 3 = 0 THEN 'Số lượng tuyển: ' || n || ' người, ' ELSE '' END || trim(repeat(o_orderpriority || ' ', (o_custkey % 30 + 1)::INT)) AS req FROM (SELECT *, o_custkey % 9 AS n FROM orders))""")
def job_descriptions(spark, sf):
    """Short descriptions of composed jobs."""
    k, n = F.col("o_orderkey"), F.col("o_custkey") % 9
    text = F.concat(F.when(k % 3 == 0, F.concat(F.lit("Số lượng tuyển: "), _s(n), F.lit(" người,  "))).otherwise(""), F.expr("repeat(o_orderpriority || ' ', int(o_custkey % 30 + 1))"))
    none = k % 7 == 0
    low, high = F.when(~none & (k % 4).isin(0, 1), n.cast("double")), F.when(~none & (k % 4).isin(0, 2), n + F.lit(1.5))
    return table(spark, sf, "orders").select("o_orderkey", questions.job_description(F.when(~none, text), low, high).alias("description"))
