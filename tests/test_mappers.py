"""Includes of mappers: any depth, over files, circles, precedence, and branches."""

from __future__ import annotations

from evidentia.sources import files

SAME = '<sql id="same">{}</sql>'
FILES = {
    "a.xml": '<mapper namespace="m.a"><sql id="f1">1 <include refid="f2"/></sql><sql id="f2">2 <include refid="m.b.f3"/> 2</sql>' + SAME.format("mine")
    + '<select id="deep">SELECT <include refid="f1"/> FROM t</select><select id="twice">x <include refid="same"/> y <include\n refid = "same" ></include> z</select><select id="none"><include refid="gone"/>q</select></mapper>',
    "b.xml": "<mapper namespace='m.b'><sql id='f3'>3 <include refid='f4'/></sql><sql id='f4'>4 <include refid='m.c.f5'/></sql>" + SAME.format("theirs")
    + "<select id='s'>SELECT <include refid='same'/></select><select id='borrowed'><include refid='f1'/></select></mapper>",
    "c.xml": '<mapper namespace="m.c"><sql id="f5">5 <include refid="same"/></sql><sql id="x">x <include refid="y"/> x</sql><sql id="y">y <include refid="x"/> y</sql><!-- <sql id="x">old</sql> -->'
    '<update id="circle">UPDATE <include refid="x"/></update><delete id="ways">DELETE FROM <if test="a > 1 and b != \'>\'">t1</if><choose><when test="c">t2</when><otherwise>t3</otherwise></choose> WHERE <![CDATA[ a < 1 ]]></delete></mapper>',
    "d.xml": "<beans/>",
    "e.xml": None,
}


def test_includes(spark):
    rows = spark.createDataFrame([*FILES.items()], "path string, content string")
    got = {r.statement: (r.verb, r.sql, r.branches) for r in files.mapper_statements(rows).collect()}
    texts = {k: v[1] for k, v in got.items()}
    assert texts == {
        # the fragment of the statement's own file comes before others of the name, wherever the include stands
        "m.a.deep": "SELECT 1 2 3 4 5 mine 2 FROM t", "m.a.twice": "x mine y mine z", "m.a.none": "q", "m.b.s": "SELECT theirs", "m.b.borrowed": "1 2 3 4 5 theirs 2",
        "m.c.circle": "UPDATE x y y x", "m.c.ways": "DELETE FROM t1 t2 t3 WHERE a < 1",
    }
    assert got["m.c.ways"][0] == "delete" and got["m.c.ways"][2] == ["DELETE FROM", "t1", "t2", "t3", "WHERE a < 1"]


def test_no_files(spark):
    assert files.mapper_statements(spark.createDataFrame([], "path string, content string")).collect() == []
