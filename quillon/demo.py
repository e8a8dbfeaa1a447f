"""A small database to try statements on: Students, Courses and Enrollments, with rows made by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from .engine import Engine
from .types import field

STUDENTS, COURSES, ENROLLMENTS = 200, 15, 1000
_MAJORS = ["Astronomy", "Botany", "Geology", "History", "Logic", "Music"]
_TOPICS = ["Stars", "Mosses", "Glaciers", "Archives", "Proofs", "Scales", "Orbits", "Ferns", "Basalt", "Maps", "Sets", "Fugues", "Comets", "Roots", "Reefs"]


def load_demo(engine: Engine) -> list[str]:
    """Create the tables that are not there yet, and give their names."""
    spark = engine.spark
    majors, topics = (F.array(*map(F.lit, names)) for names in (_MAJORS, _TOPICS))
    i = F.col("id")
    tables = {
        "Students": (
            [field("sid", "int"), field("name", "string", 20), field("major", "string", 20), field("gpa", "float")],
            spark.range(1, STUDENTS + 1).select(i.cast("int").alias("sid"), F.format_string("Student %03d", i).alias("name"), F.get(majors, (i * i + i % 7) % len(_MAJORS)).alias("major"), ((i * 37 % 30 + 10) / 10).cast("float").alias("gpa")),
        ),
        "Courses": (
            [field("cid", "int"), field("name", "string", 20), field("department", "string", 20)],
            spark.range(1, COURSES + 1).select(i.cast("int").alias("cid"), F.get(topics, i - 1).alias("name"), F.get(majors, (i - 1) % len(_MAJORS)).alias("department")),
        ),
        "Enrollments": (
            [field("sid", "int"), field("cid", "int")],
            # five courses for each student, from a start of the student's own
            spark.range(ENROLLMENTS).select((i % STUDENTS + 1).cast("int").alias("sid"), ((i % STUDENTS * 7 + F.floor(i / STUDENTS) * 3) % COURSES + 1).cast("int").alias("cid")),
        ),
    }
    made = []
    with engine.begin() as t:
        for name, (fields, df) in tables.items():
            if name.lower() not in t.tables.state:
                t.create_table(name, type(df.schema)(fields))
                t.append(name, df)
                made.append(name)
    return made
