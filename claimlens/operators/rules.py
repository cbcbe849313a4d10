"""Rules across records: what a visit, scheme or drug should or should not have together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions.flags import filled, person_name, picks
from claimlens.operators.scope import children_of, date_window, link, of_dates
from claimlens.params import Params
from claimlens.sources.tables import Tables

# The treatment code a cancer procedure calls for.
Z_CODE_BY_PROCEDURE = {"9224": "Z510", "9925": "Z511"}
Z_CODES = tuple(Z_CODE_BY_PROCEDURE.values())
CANCER_GROUP = "UCS"
ADDED_DIAGNOSIS_TYPE = "4"

# Names that mark a controlled drug, by class.
CONTROLLED_DRUGS = {
    "ยาเสพติดให้โทษ ประเภท 1": (
        "Heroin เฮโรอีน Diacetylmorphine Cocaine โคเคน MDMA Ecstasy LSD Lysergic Methamphetamine เมทแอมเฟตามีน "
        "Amphetamine แอมเฟตามีน"
    ),
    "ยาเสพติดให้โทษ ประเภท 2": (
        "Morphine มอร์ฟีน Fentanyl เฟนทานิล Pethidine เพทิดีน Meperidine Methadone เมทาโดน Oxycodone ออกซิโคโดน "
        "Hydromorphone ไฮโดรมอร์โฟน Buprenorphine บูพรีนอร์ฟีน Tramadol ทราเมดอล Codeine โคดีอีน"
    ),
    "ยาเสพติดให้โทษ ประเภท 3": "Dihydrocodeine ไดไฮโดรโคดีอีน Ethylmorphine เอทิลมอร์ฟีน",
    "ยาเสพติดให้โทษ ประเภท 4": "Cannabis กัญชา Marijuana THC Tetrahydrocannabinol",
    "ยาเสพติดให้โทษ ประเภท 5": "กระท่อม Kratom Mitragyna Mitragynine",
    "วัตถุออกฤทธิ์ต่อจิตประสาท ประเภท 1": "Midazolam มิดาโซแลม",
    "วัตถุออกฤทธิ์ต่อจิตประสาท ประเภท 2": (
        "Diazepam ไดอาซีแพม ไดอะซีแพม Alprazolam แอลปราโซแลม Clonazepam โคลนาซีแพม Lorazepam โลราซีแพม "
        "Zolpidem โซลพิเดม Triazolam ไตรอาโซแลม Nitrazepam นิทราซีแพม Flunitrazepam ฟลูนิทราซีแพม"
    ),
    "วัตถุออกฤทธิ์ต่อจิตประสาท ประเภท 3": (
        "Phenobarbital ฟีโนบาร์บิทอล Phenobarbitone Barbiturate บาร์บิทูเรต Amobarbital Butabarbital Secobarbital "
        "Pentobarbital เพนโทบาร์บิทอล"
    ),
    "วัตถุออกฤทธิ์ต่อจิตประสาท ประเภท 4": (
        "Ketamine คีตามีน Meprobamate มีโพรบาเมท Chlordiazepoxide คลอร์ไดอาซีพอกไซด์ Clorazepate โคลราซีเพต "
        "Oxazepam ออกซาซีแพม Temazepam เทมาซีแพม Flurazepam ฟลูราซีแพม Bromazepam โบรมาซีแพม Estazolam เอสตาโซแลม"
    ),
}
CONTROLLED_NAME_COLUMNS = ("generic_name", "name", "thai_name")
DRUG_INCOMES = ("03", "17")


# -- SQL's IN and NOT IN over another table ------------------------------------


def _listed(other: DataFrame, column: str) -> tuple[DataFrame, Column, Column]:
    """The other column's distinct values, whether there is any, and whether one is NULL."""
    values = other.select(F.col(column).alias("_listed"))
    counts = values.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count("_listed").alias("known"))).scalar()
    return values.where("_listed IS NOT NULL").distinct(), counts["n"] > 0, counts["n"] > counts["known"]


def not_in(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """Rows whose value is NOT IN the other column, with SQL's treatment of NULL.

    A NULL in the list leaves no rows, and a NULL value passes only an empty
    list.  An equality anti join carries the matching and one pair of counts
    the NULL rule, so neither side has to be broadcast.
    """
    values, any_listed, any_null = _listed(other, other_column)
    rows = df.join(values, F.col(column) == F.col("_listed"), "left_anti")
    return rows.where(~any_listed | (~any_null & F.col(column).isNotNull()))


def with_membership(df: DataFrame, column: str, other: DataFrame, other_column: str, name: str) -> DataFrame:
    """Add the truth value of ``column IN (other)``: true, false or unknown."""
    values, any_listed, any_null = _listed(other, other_column)
    rows = df.join(values, F.col(column) == F.col("_listed"), "left")
    unknown = any_listed & (any_null | F.col(column).isNull())
    value = F.when(F.col("_listed").isNotNull(), True).when(unknown, F.lit(None).cast("boolean")).otherwise(False)
    return rows.withColumn(name, value).drop("_listed")


# -- cancer visits without a treatment code -----------------------------------


def _z_code(procedure: Column) -> Column:
    code = F.lit("")
    for icd9, z in Z_CODE_BY_PROCEDURE.items():
        code = F.when(procedure == icd9, z).otherwise(code)
    return code


def _cancer_visits(t: Tables, p: Params, once: bool = False) -> DataFrame:
    """Visits ``o`` with a cancer main diagnosis and no treatment code in the window.

    ``once`` lists equal diagnoses of a visit once.
    """
    schemes = t["pttype"].where(F.col("hipdata_code") == CANCER_GROUP).select("pttype", F.col("name").alias("scheme"))
    main = of_dates(t, "ovstdiag", p).where("diagtype = '1' AND upper(icd10) LIKE 'C%'").select("vn", "icd10", "doctor")
    main = main.distinct() if once else main
    treated = t["ovstdiag"].where(F.col("icd10").isin(*Z_CODES) & date_window("vstdate", p))
    visits = t["ovst"].where(date_window("vstdate", p)).join(schemes, "pttype")
    visits = not_in(visits.join(main, "vn"), "vn", treated, "vn").alias("o")
    return link(visits, t["doctor"], "d", "d.code = o.doctor")


def _cancer_operations(t: Tables) -> DataFrame:
    operations = t["doctor_operation"].where(F.col("icd9").isin(*Z_CODE_BY_PROCEDURE))
    return link(operations.alias("q"), t["er_oper_code"], "e", "e.er_oper_code = q.er_oper_code").select(
        *picks("q.vn, q.icd9, e.name AS oper_name")
    )


def cancer_missing_z(t: Tables, p: Params) -> DataFrame:
    """Cancer visits with a listed drug and no Z510/Z511, with the code to add.

    The result lists equal rows once, so diagnoses, procedures and texts are
    each made distinct per visit before they are joined.
    """
    drugs = t["drugitems_cancer"].select("icode")
    with_drug = of_dates(t, "opitemrece", p).join(drugs, "icode", "left_semi").select("vn")
    visits = _cancer_visits(t, p, once=True)
    visits = visits.join(with_drug.select(F.col("vn").alias("_drug_vn")), F.expr("o.vn = _drug_vn"), "left_semi")
    # candidates first: text is gathered for their visits only
    texts = children_of(visits.select("o.vn"), t, "ovst_doctor_diag", p).where("diag_text IS NOT NULL").select("vn", "diag_text").distinct()
    texts = texts.groupBy("vn").agg(
        F.expr("listagg(diag_text, ', ') WITHIN GROUP (ORDER BY diag_text)").alias("diag_text")
    )
    rows = link(visits, t["visit_pttype"], "vp", "vp.vn = o.vn AND vp.pttype = o.pttype")
    rows = link(rows, _cancer_operations(t).distinct(), "q", "q.vn = o.vn")
    rows = link(rows, texts, "x", "x.vn = o.vn")
    rows = link(rows, t["icd101"], "n", "n.code = o.icd10")
    rows = link(rows, t["patient"], "p", "p.hn = o.hn")
    return rows.select(
        F.col("o.vstdate").alias("วันที่รับบริการ"),
        F.col("o.hn").alias("HN"),
        F.col("o.vn").alias("VN"),
        F.col("o.oqueue").alias("คิวรับบริการ"),
        F.col("p.cid"),
        person_name("p").alias("ชื่อ-นามสกุล"),
        F.col("o.scheme").alias("สิทธิการรักษา"),
        F.col("vp.auth_code").alias("authen_code"),
        F.col("o.icd10").alias("icd10 มะเร็ง"),
        F.col("n.name").alias("ชื่อicd10 มะเร็ง"),
        F.col("q.icd9"),
        F.col("q.oper_name").alias("หัตถการ"),
        _z_code(F.col("q.icd9")).alias("icd10 ที่ต้องลงเพิ่ม"),
        F.col("d.name").alias("แพทย์วินิจฉัย"),
        F.col("x.diag_text"),
    ).dropDuplicates()


def cancer_z_preview(t: Tables, p: Params) -> DataFrame:
    """The diagnosis rows to add: cancer visits with the procedure but no Z510/Z511."""
    rows = link(_cancer_visits(t, p), _cancer_operations(t), "q", "q.vn = o.vn", "inner")
    return rows.select(
        *picks("o.vn, q.icd9, q.oper_name AS er_oper_name, o.hn, o.vsttime, o.vstdate, o.doctor AS doctor_code, d.name AS doctor"),
        _z_code(F.col("q.icd9")).alias("icd10_add"),
        F.lit(ADDED_DIAGNOSIS_TYPE).alias("diagtype"),
    )


def cancer_procedures(t: Tables, p: Params | None = None) -> DataFrame:
    """Procedures that stand for chemotherapy or radiotherapy."""
    return t["er_oper_code"].where(F.col("icd9cm").isin(*Z_CODE_BY_PROCEDURE)).select("icode", "name", "icd9cm", "price")


# -- charges that exclude one another ------------------------------------------


def co_occurs(t: Tables, p: Params, first: DataFrame, second: DataFrame) -> DataFrame:
    """Visits of the window charged for an item of each list.

    The lists become marks on the item code; a visit's marks are combined with
    one aggregate, so lines are never paired with one another.
    """
    marks = (
        first.select("icode", F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionByName(second.select("icode", F.lit(0).alias("a"), F.lit(1).alias("b")))
        .groupBy("icode")
        .agg(F.max("a").alias("a"), F.max("b").alias("b"))
    )
    lines = t["opitemrece"].where(date_window("vstdate", p))
    marked = lines.select("vn", "icode").join(marks, "icode").groupBy("vn").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    both = marked.where("a = 1 AND b = 1").select("vn")
    visits = lines.select("vn", "hn", "vstdate").join(both, "vn", "left_semi").distinct()
    rows = link(visits.alias("op"), t["patient"], "p", "p.hn = op.hn", "inner")
    return rows.select(
        F.col("op.vstdate").alias("วันที่รับบริการ"),
        F.col("op.hn").alias("HN"),
        person_name("p").alias("ชื่อ-นามสกุล"),
        F.col("op.vn").alias("VN"),
    ).distinct()


def adp_items(t: Tables, code: str) -> DataFrame:
    return t["nondrugitems"].where(F.col("nhso_adp_code") == code).select("icode")


def walkin_with_cancer(t: Tables, p: Params) -> DataFrame:
    """Visits charged both WALKIN and CANCER."""
    return co_occurs(t, p, adp_items(t, "WALKIN"), adp_items(t, "CANCER"))


def adp_with_morphine(t: Tables, p: Params) -> DataFrame:
    """Visits charged ADP30001 together with a listed morphine drug."""
    return co_occurs(t, p, adp_items(t, "ADP30001"), t["drug_morphine"].select("icode"))


# -- catalogue rules -----------------------------------------------------------


def payer_code_unknown(t: Tables, p: Params | None = None) -> DataFrame:
    """Schemes whose national code is not in the national list."""
    rows = not_in(t["pttype"].select("nhso_code", "name"), "nhso_code", t["provis_instype"], "code")
    return rows.withColumn("note", F.lit("เพิ่มข้อมูลสิทธิในตาราง provis_instype"))


def controlled_name(names: str) -> str:
    """SQL text: one of the names occurs in any name column, in any letter case."""
    hits = (f"contains(lower({c}), '{name.lower()}')" for c in CONTROLLED_NAME_COLUMNS for name in names.split())
    return "coalesce(" + " OR ".join(f"coalesce({hit}, FALSE)" for hit in hits) + ", FALSE)"


def controlled_drug_class(t: Tables, p: Params | None = None) -> DataFrame:
    """Per income category and class: active drugs of that class, and those with a control type.

    All classes are counted in one pass over the drug list.
    """
    drugs = t["drugitems"].where("istatus = 'Y'")
    drugs = drugs.withColumn("income", F.when(F.length("income") == 1, F.lpad("income", 2, "0")).otherwise(F.col("income"))).where(F.col("income").isin(*DRUG_INCOMES))
    sums = []
    for i, names in enumerate(CONTROLLED_DRUGS.values()):
        hit = F.expr(controlled_name(names))
        sums.append(F.count(F.when(hit, 1)).alias(f"tot{i}"))
        sums.append(F.count(F.when(hit & filled(F.col("drug_control_type_id").cast("string")), 1)).alias(f"ok{i}"))
    wide = drugs.groupBy("income").agg(*sums)
    parts = ", ".join(f"'{label}', tot{i}, ok{i}" for i, label in enumerate(CONTROLLED_DRUGS))
    return wide.select("income", F.expr(f"stack({len(CONTROLLED_DRUGS)}, {parts}) AS (drug_class, tot, ok)"))
