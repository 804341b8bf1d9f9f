"""SQL in Java: each way of putting it together, confidence, branches, comments, inner classes, odd files."""

from __future__ import annotations

from evidentia.operators import java_strings

CODE = r'''package a.b; // String no = "SELECT 1 FROM comment";
public class Dao {
  static final String ALL = "SELECT * FROM all_t";
  /* String gone = "SELECT 2 FROM comment"; */
  public Dao(String s) { this.s = "DELETE FROM made"; }
  @Override public List<Row> find(int id) throws SQLException {
    String t = "users";
    String sql = "SELECT * FROM " + t
        + " WHERE id = " + id;
    String sent = "UPDATE x SET a = " + name(id, 2) + (" WHERE b = " + b);
    stmt.executeQuery(sent);
    String f = String.format("SELECT %s FROM t%d WHERE a like '%x'", "c", 7), r = "SELECT @@ FROM t".replace("@@", "z");
    String pick = a ? "SELECT 1 " : "SELECT 2 ";
    t = "DELETE FROM " + t;
    for (int i = 0; i < 3; i++) { run(() -> { String in = "SELECT 3 FROM lambda"; use(in); }); }
    return null;
  }
  void build(boolean x) {
    StringBuilder sb = new StringBuilder();
    StringBuffer other = new StringBuffer();
    sb.append("SELECT a").append(col).append(" FROM t");
    other.append("INSERT INTO ").append("log");
    if (x) sb.append(" WHERE \"q\" = 1");
  }
  class Inner { void go() { String q = "WITH w AS (SELECT 1) SELECT 2"; } }
  String after() { String late = "MERGE INTO m"; return late; }
}
'''


def test_each_way(spark):
    rows = [("D.java", CODE), ("empty.java", ""), ("null.java", None), ("torn.java", 'class T { void f( { String s = "SELECT 1 FROM x" + ; } } } )'), ("other.java", "class O {}")]
    found = java_strings.sql_strings(spark.createDataFrame(rows, "path string, content string")).collect()
    got = {(r.container, r.sql_text, r.recovery_mode, r.confidence, r.branch_detected, r.line_start, r.line_end) for r in found if r.path == "D.java"}
    assert got == {
        ("Dao", "SELECT * FROM all_t", "literal", "medium", False, 3, 3),
        ("Dao", "DELETE FROM made", "literal", "low", False, 5, 5),
        ("Dao.find", "SELECT * FROM users WHERE id = ${?}", "local_var", "medium", False, 8, 9),
        ("Dao.find", "UPDATE x SET a = ${?} WHERE b = ${?}", "concat", "medium", False, 10, 10),
        ("Dao.find", "SELECT c FROM t7 WHERE a like '%x'", "literal", "medium", False, 12, 12),
        ("Dao.find", "SELECT z FROM t", "literal", "medium", False, 12, 12),
        ("Dao.find", "DELETE FROM users", "local_var", "low", False, 14, 14),
        ("Dao.find", "SELECT 3 FROM lambda", "literal", "medium", False, 15, 15),
        ("Dao.build", "SELECT a${?} FROM t WHERE \\\"q\\\" = 1", "string_builder", "low", True, 18, 24),
        ("Dao.build", "INSERT INTO log", "string_builder", "low", False, 18, 24),
        ("Inner.go", "WITH w AS (SELECT 1) SELECT 2", "literal", "medium", False, 25, 25),
        ("Dao.after", "MERGE INTO m", "literal", "medium", False, 26, 26),
    }


def test_no_files(spark):
    assert java_strings.sql_strings(spark.createDataFrame([], "path string, content string")).collect() == []
