"""Course-database checks on the literal rows of the original script."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from quarry.plans import quality as qa
from quarry.sources import files as fs
from tests.conftest import rows

STUDENTS = "student_no int, teacher_no string, course_no string, student_name string, " \
           "email string, birth_date date"
STUDENT_ROWS = [
    (1, "2", "e001", "Sadio M", "sad1234@gmail.com", date(2001, 12, 12)),
    (2, "3", "g001", "Soner G ", "sa1ah1@hotmail.com", date(1999, 1, 30)),
    (3, "4", "j001", "Diego J", "di3go@hotmail.com", date(1986, 11, 19)),
    (4, "5", "c001", "Rick P", "r1ck123@gmail.com", date(1994, 1, 1)),
    (5, "7", "t001", "Lana D", "1ana_d@gmail.com", date(1992, 4, 4)),
    (6, "1", "s001", "Kate M", "ka10n@gmail.com", date(1989, 3, 1)),
    (7, "6", "f001", "Anne L", "annn007@gmail.com", date(2003, 9, 21)),
    (8, "2", "e001", "Sadio M", "sad1234@gmail.com", date(2001, 12, 12)),
    (9, "2", "e001", "Sadio M", "sad1234@gmail.com", date(2001, 12, 12)),
    (10, "2", "e001", "Sadio M", "sad1234@gmail.com", date(2001, 12, 12)),
]
TEACHERS = [("1", "Rosa D", "063456476"), ("2", "Toma G ", "073416765"),
            ("3", "Nina C", "063456999"), ("4", "Adelin G", "097156786"),
            ("5", "Lena R", "099456432"), ("6", "Katrin S", "099868386"),
            ("7", "Natli F", "063777473")]
COURSES = [("e001", "English", "2021-03-30", "2021-09-30"), ("g001", "German", "2021-04-01", "2021-10-01"),
           ("j001", "Japanese", "2021-03-14", "2021-11-14"), ("c001", "Chinese", "2021-03-05", "2022-01-012"),
           ("t001", "Turkish", "2021-03-12", "2021-09-15"), ("s001", "Spanish", "2021-03-13", "2021-10-12"),
           ("f001", "French", "2021-03-23", "2021-08-29")]
NON_KEY = ["teacher_no", "course_no", "student_name", "email", "birth_date"]


@pytest.fixture(scope="module")
def students(spark):
    return spark.createDataFrame(STUDENT_ROWS, STUDENTS)


def test_duplicate_rows(students):
    got = sorted(r["student_no"] for r in qa.duplicate_rows(students, NON_KEY).collect())
    assert got == [1, 8, 9, 10]


def test_duplicate_rows_null_keys_never_match(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "x")], "id int, k string")
    assert sorted(r["id"] for r in qa.duplicate_rows(df, ["k"]).collect()) == [3, 4]


def test_unique_violations(spark, students):
    teachers = spark.createDataFrame(TEACHERS, "teacher_no string, teacher_name string, phone_no string")
    assert qa.unique_violations(teachers, ["phone_no"]).count() == 0
    assert qa.unique_violations(students, ["student_no", "birth_date"]).count() == 0
    assert rows(qa.unique_violations(students, NON_KEY).select("n")) == [(4,)]


def test_type_violations(spark):
    course = spark.createDataFrame(COURSES, "course_no string, course_name string, "
                                            "start_date string, end_date string")
    got = rows(qa.type_violations(course, "course_no", {
        "start_date": ("date",), "end_date": ("date",), "course_name": ("varchar", 20),
        "course_no": ("char", 4)}))
    assert got == [("c001", "end_date", "2022-01-012", "not a date")]


def test_null_violations(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, "a", float("nan"))], "a int, b string, c double")
    assert rows(qa.null_violations(df, ["a", "b", "c"])) == [("b", 1), ("c", 1)]


def test_partition_counts(students):
    got = rows(qa.partition_counts(students, "birth_date", 1985, 2005))
    assert got == [(1986, 1), (1989, 1), (1992, 1), (1994, 1), (1999, 1), (2001, 4), (2003, 1)]


def test_pruned_read_touches_one_partition(spark, students):
    path = fs.fresh_path(spark, "students")
    fs.write_year_partitioned(students, path, "birth_date", 1985, 2005)
    got = fs.read_date_range(spark, path, "birth_date", "1989-01-01", "1989-12-31", 1985, 2005)
    assert [r["student_no"] for r in got.collect()] == [6]
    assert fs.partitions_read(got).count() == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part_year" in plan


def test_point_lookup_pushes_filter(spark):
    teachers = spark.createDataFrame(TEACHERS, "teacher_no string, teacher_name string, phone_no string")
    path = fs.fresh_path(spark, "teachers")
    teachers.write.parquet(path)
    got = fs.point_lookup(spark.read.parquet(path), "phone_no", "099456432")
    assert rows(got) == [("5", "Lena R", "099456432")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(phone_no,099456432)" in plan


def test_typed_table_pads_char_and_rejects_long_varchar(spark):
    path = fs.fresh_path(spark, "typed")
    fs.create_typed_table(spark, "t_teachers", "teacher_no CHAR(4), teacher_name VARCHAR(30), "
                                               "phone_no VARCHAR(15)", path)
    fs.append_rows(spark, "t_teachers", spark.createDataFrame(TEACHERS, "a string, b string, c string"))
    assert spark.table("t_teachers").where(F.col("teacher_name") == "Lena R").first()[0] == "5   "
    too_long = spark.createDataFrame([("9", "x" * 31, "1")], "a string, b string, c string")
    with pytest.raises(Exception):
        fs.append_rows(spark, "t_teachers", too_long)


def test_duplicate_count(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, "b")], "x int, y string")
    assert qa.duplicate_count(df).first()[0] == 2


def test_duplicate_count_with_nulls(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, None), (1, None), (1, None), (2, "b")],
                               "x int, y string")
    assert qa.duplicate_count(df).first()[0] == 3
