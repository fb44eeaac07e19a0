"""SQL flows of Java methods."""

import pytest

from auditframe.operators.java import java_sql_flows

HEAD = "class A {\n void doGet(HttpServletRequest request, HttpServletResponse response) throws IOException {\n  String id = request.getParameter(\"id\");\n  Statement statement = connection.createStatement();\n"


def sinks(body: str, more: str = "") -> list[int]:
    return [r[5] - 4 for r in java_sql_flows(HEAD + body + "\n }\n" + more + "\n}\n")]


@pytest.mark.parametrize(
    "body",
    [
        'statement.executeQuery("select * from t where id=" + id);',
        'connection.prepareStatement("select " + id).executeQuery();',
        'StringBuilder b = new StringBuilder("select "); b.append("x").append(id); statement.execute(b.toString());',
        'String q = "a"; if (flag) { q = "select " + id; } else { q = "b"; } statement.executeUpdate(q);',
        'String q = flag ? "a" : id; statement.execute(q);',
        'String q = ""; for (int i = 0; i < 3; i++) { statement.execute(q); q += id; }',
        'List<String> xs = new ArrayList<>(); xs.add("a"); xs.add(id); statement.execute(xs.get(1));',
        'Map<String, String> m = new HashMap<String, String>(); m.put("a", "x"); m.put("b", id); statement.execute(m.get("b"));',
        'String q = (String) id; statement.execute("select " + q.trim().toLowerCase());',
        'String q; switch (kind) { case "a": q = "x"; break; case "b": q = id; break; default: q = "z"; } statement.execute(q);',
        'try { statement.execute("x"); } catch (SQLException e) { statement.execute("y" + id); } finally { }',
        'for (Cookie c : request.getCookies()) { statement.execute("select " + c.getValue()); }',
        'jdbcTemplate.queryForList("select '"'"'" + id + "'"'"'");',
        'String q = "select /* " + id; // a comment; "with a quote\n statement.execute(q);',
        'String[] q = {"a", id}; statement.execute(q[1]);',
    ],
)
def test_found(body):
    assert len(sinks(body)) == 1


@pytest.mark.parametrize(
    "body",
    [
        'PreparedStatement p = connection.prepareStatement("select * from t where id=?"); p.setString(1, id); p.executeQuery();',
        'statement.executeQuery("select * from t where id=" + Integer.parseInt(id));',
        'String q = "select " + id; q = "select 1"; statement.execute(q);',
        'if (1 + 1 == 3) { statement.execute("select " + id); }',
        'String q = 7 * 6 > 50 ? id : "fixed"; statement.execute(q);',
        'List<String> xs = new ArrayList<>(); xs.add("a"); xs.add(id); statement.execute(xs.get(0));',
        'List<String> xs = new ArrayList<>(); xs.add("a"); xs.add(id); xs.remove(0); xs.add("b"); statement.execute(xs.get(1));',
        'Map<String, String> m = new HashMap<>(); m.put("a", "x"); m.put("b", id); statement.execute(m.get("a"));',
        'String s = "statement.execute(id)"; log.info(s + id);',
        'String guess = "ABC"; String q; switch (guess.charAt(1)) { case \'A\': q = id; break; case \'B\': q = "b"; break; default: q = id; } statement.execute(q);',
        'return; ',
    ],
)
def test_clean(body):
    assert sinks(body) == []


def test_helpers_of_the_file():
    helper = ' private String part(String x) { return "select " + x; }\n private String fixed(String x) { return "select 1"; }\n private void go(Statement s, String q) { s.execute(q); }'
    assert sinks("statement.execute(part(id));", helper) == [1]
    assert sinks("statement.execute(fixed(id));", helper) == []
    assert len(sinks("go(statement, part(id));", helper)) == 1


def test_spring_parameters_and_lines():
    text = 'class B {\n @GetMapping("/x")\n public List<User> find(@RequestParam("q") String q) {\n  return jdbcTemplate.query("select * from u where n=\'" + q + "\'", mapper);\n }\n public void other(String q) { jdbcTemplate.query("select " + q); }\n}\n'
    assert [(r[4], r[5]) for r in java_sql_flows(text)] == [(3, 4)]


def test_incomplete_files_say_so():
    assert java_sql_flows("class A { void doGet(HttpServletRequest r) { ")[0][0] == "POLYGLOT_ANALYSIS_INCOMPLETE"
    assert java_sql_flows("") == []
