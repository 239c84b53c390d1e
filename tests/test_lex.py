import pytest

from graphloom.functions import lex
from graphloom.sources.files import is_test, kinds, scan, skipped, write_json
from graphloom.streaming.upserts import NodeTable, merged

MODULE = """
/* import ghost from 'ghost' */
import React, { useMemo } from "react"   // import other from 'other'
import * as geo from '../geo'
import type { Lane } from "./lane"
import './side-effect.css'
export * from './public'
export { a as b, c } from "../../shared/names"
const quoted = `import t from 'template'`, escaped = 'import \\'x\\' from "y"'
async function later() {
  await import("./chunk")
  await import(`./plain`)
  await import(`./${name}`)
  await import(prefix + '/x')
  loader.import('./method')
}
"""


def test_references_of_a_whole_module():
    found = lex.module_references(MODULE)
    assert [(s, k) for s, k, _ in found] == [
        ("react", "static"), ("../geo", "static"), ("./lane", "static"), ("./side-effect.css", "static"), ("./public", "static"), ("../../shared/names", "static"),
        ("./chunk", "dynamic"), ("./plain", "dynamic"),
    ]
    assert [MODULE.count("\n", 0, at) + 1 for _, _, at in found] == [3, 4, 5, 6, 7, 8, 11, 12]


CLIENT = """
const ROOT = '/api/lanes'
export class LaneClient extends Base {
  private stops = "/api/stops"
  all() { return this.get<Lane[]>(ROOT) }
  one(id) { return this.get(`${ROOT}/${id}`) }
  move(id) { return this.patch(`${this.stops}/${id}/move`, {}) }
  any() { return this.request(ROOT) }
  raw() { return fetch("/api/raw", { method: 'put', body }) }
  plain() { return fetch('/elsewhere') }
  remove() { return del('/api/lanes/7') }
  sent() { return send('POST', '/api/mail') }
  asked() { return request({ url: '/api/asked' }) }
  listed() { return axios({ url: '/api/listed', method: "GET" }) }
  summed() { return fetch(ROOT + '/' + id) }   // fetch('/api/comment')
}
"""


def test_endpoints_of_a_whole_client():
    assert [(e.url, e.method, e.strategy) for e in lex.frontend_endpoints(CLIENT)] == [
        ("/api/lanes", "GET", "instance-methods"), ("/api/lanes/{}", "GET", "instance-methods"), ("/api/stops/{}/move", "PATCH", "instance-methods"), ("/api/raw", "PUT", "fetch"),
        ("/api/lanes/7", "DELETE", "free-functions"), ("/api/mail", "POST", "positional-methods"), ("/api/asked", "ANY", "request-objects"), ("/api/listed", "GET", "object-arguments"),
    ]


CONTROLLER = """
namespace Harbour.Api.Controllers;
// [Route("api/ghost")]
[ApiController]
[Route("api/ships")]
public sealed class ShipsController(IShipReader reader) : ControllerBase
{
    private const string Text = "[HttpGet] public object Fake()";
    [HttpGet] public Task<IActionResult> List() => Ok(_mediator.Send(new ListShipsQuery()));
    [HttpGet("{id}/crew")]
    [Authorize]
    public IActionResult Crew(int id) { return Ok(); }
    [HttpPost("dock")] public async Task Dock() { if (await a()) { await b(); } foreach (var s in ships) { _dbContext.Add(s); } }
}
public class Plain { public void HttpGet() {} }
"""


def test_controller():
    assert [(e.url, e.method, e.action) for e in lex.controller_endpoints(CONTROLLER)] == [("/api/ships", "GET", "List"), ("/api/ships/{id}/crew", "GET", "Crew"), ("/api/ships/dock", "POST", "Dock")]
    assert lex.controller_endpoints(CONTROLLER.replace('"api/ships"', "Routes.Ships")) == []
    assert lex.dispatched_requests(CONTROLLER) == ["ListShipsQuery"] and lex.constructor_dependencies(CONTROLLER) == ["IShipReader"]
    assert sorted(w for w, _ in lex.thick_controller(CONTROLLER)) == ["branch with multiple awaits", "direct persistence access", "loop in controller action"]


def test_storage_facts():
    context = "public class HarbourDb : DbContext, IUnit<Ship> { public DbSet<Ship> Ships { get; set; } } public record Draught(int Metres) : Base.Value;"
    assert lex.type_declarations(context) == [("class", "HarbourDb", ["DbContext", "IUnit"]), ("record", "Draught", ["Value"])]
    assert lex.db_sets(context) == [("Ship", "Ships")]
    config = 'class ShipMap : IEntityTypeConfiguration<Ship> { void Configure(B b) { b.ToTable("ships"); } }'
    assert lex.table_name(config) == "ships" and lex.configured_entity(config) == "Ship"
    entity = "public class Ship { public int Id { get; set; } public ICollection<Sailor> Crew { get; init; } private Dock Dock { get; set; } public void Sink() {} }"
    assert set(lex.property_types(entity)) == {("Ship", "int"), ("Ship", "ICollection"), ("Ship", "Sailor")}
    service = "public class Pilot : IPilot { private readonly IMap _m; public Pilot(IMap map, ILogger<Pilot> log, [From] Clock clock) { } void X() { new Pilot(a, b); } }"
    assert lex.constructor_dependencies(service) == ["IMap", "ILogger", "From"] or lex.constructor_dependencies(service) == ["IMap", "ILogger", "Clock"]


def test_rule_facts():
    source = "let a: any\nconst b = c as any\nconst d: Array<any> = []\n// e: any\nconst many = 'x: any'; obj.any = 1\n"
    assert [(w, source.count("\n", 0, at) + 1) for w, at in lex.any_types(source)] == [(": any", 1), ("as any", 2), ("Array<any>", 3)]
    routes = "const P = lazy(() => import('./P'))\nconst r = [{ path: '/', component: P, permission: 'x' }]\n<Suspense />\ntype C = React.ComponentType\n"
    assert {w: routes.count("\n", 0, at) + 1 for w, at in lex.route_shape(routes)} == {"lazy()": 1, "permission in route config": 2, "Suspense": 3, "React.ComponentType": 4}


@pytest.mark.parametrize(("source", "n"), [("", 0), ("it('a', f); it.skip('b', f)\ntest.each([1, 2])('c', f)", 3), ("suite.it('no', f); // it('no')\nconst it = 'it(1)'", 0), ("test.concurrent.only('x', f)", 1)])
def test_cases(source, n):
    assert lex.test_cases(source) == n


def test_broken_sources():
    for source in ("import", "import {", "fetch(", "export * from", "`${", "'", "/*", "import('x"):
        assert lex.module_references(source) == [] and lex.frontend_endpoints(source) == []
    for source in ("class", "[Route(", "public DbSet<", "class A :", '@"', "public A("):
        assert lex.controller_endpoints(source) == [] and lex.db_sets(source) == [] and lex.constructor_dependencies(source) == []


def test_scan_and_facts(spark, tmp_path):
    (tmp_path / "src/node_modules").mkdir(parents=True)
    (tmp_path / "src/a.ts").write_text("\nimport './b'\nfetch('/api/x')")
    (tmp_path / "src/a.test.ts").write_text("it('x', f)")
    (tmp_path / "src/node_modules/c.ts").write_text("import 'no'")
    (tmp_path / "src/big.ts").write_text("x" * (2 * 1024 * 1024 + 1))
    files = scan(spark, str(tmp_path), [".ts"])
    assert sorted(r.path for r in files.collect()) == ["src/a.test.ts", "src/a.ts", "src/big.ts"]
    assert [r.path for r in skipped(files).collect()] == ["src/big.ts"]
    assert sorted((r.path, r.is_test) for r in kinds(files, {"front": ("src", [".ts"])}).collect()) == [("src/a.test.ts", True), ("src/a.ts", False), ("src/big.ts", False)]
    got = {(r.path, r.fact, r.name, r.value) for r in lex.facts(files).collect()}
    assert got == {("src/a.ts", "import:static", "./b", "2"), ("src/a.ts", "endpoint", "/api/x", "GET"), ("src/a.test.ts", "test-cases", None, "1")}
    assert files.filter(is_test(files.path)).count() == 1


def test_write_json(tmp_path):
    p = str(tmp_path / "x.json")
    write_json(p, {"a": 1})
    with pytest.raises(FileExistsError):
        write_json(p, {})
    write_json(p, {}, force=True)
    assert [x.name for x in tmp_path.iterdir()] == ["x.json"]


def test_streamed_upserts(spark, tmp_path):
    schema = "id string, label string, type string, seq long"
    one = spark.createDataFrame([("a", "A", None, 1), ("b", "B", "t", 2)], schema)
    two = spark.createDataFrame([("a", None, "x", 3), ("b", "old", None, 1)], schema)
    table = NodeTable(spark, f"file://{tmp_path}/nodes", ["label", "type"])
    table.apply(one, 0)
    table.apply(two, 1)
    table.apply(two, 1)
    whole = {tuple(r) for r in merged(None, one.union(two), ["label", "type"]).collect()}
    assert {tuple(r) for r in table.read().collect()} == whole and {(r[0], r[1], r[2]) for r in whole} == {("a", "A", "x"), ("b", "B", "t")}


def test_facts_of_many_small_files_in_one_part_are_read_in_several(spark):
    from pyspark.sql import functions as F

    files = spark.range(0, 30_001, 1, 1).select(F.concat(F.lit("a"), F.col("id").cast("string"), F.lit(".ts")).alias("path"), F.lit("const a: any = 1").alias("content"))
    assert lex.facts(files).rdd.getNumPartitions() == 4
    assert lex.facts(files.limit(1)).rdd.getNumPartitions() == 1
