"""Entities and tables that C# files use, roles of C# files, addresses bound in other files."""

import pytest
from graphloom.functions import lex
from graphloom.plans.scan import Project, scan_graph

TREE = {
    "back/Data/Harbour/HarbourDb.cs": "public class HarbourDb : DbContext { public DbSet<Ship> Fleet { get; set; } public DbSet<Dock> Docks { get; set; } public DbSet<Crew> Crews { get; set; } }\n",
    "back/Data/Harbour/ShipMap.cs": 'class ShipMap : IEntityTypeConfiguration<Ship> { void C(B b) { b.ToTable("ships"); } }\n',
    "back/Domain/Harbour/Entities/Ship.cs": "public class Ship { public Dock Berth { get; set; } }\n",
    "back/Domain/Harbour/Entities/Dock.cs": "public class Dock { }\n",
    "back/Domain/Harbour/Entities/Crew.cs": "public class Crew { }\n",
    "back/App/Harbour/Handlers/MoorShipCommandHandler.cs": "using Harbour.Docks;\nclass MoorShipCommandHandler(IRepository<Ship> ships, IClock clock) : IRequestHandler<MoorShipCommand> { void H() { _db.Set<Dock>(); var c = new Crew(); _db?.Crews; } }\n",
    "back/App/Harbour/Commands/MoorShipCommand.cs": "public record MoorShipCommand(int Id);\n",
    "back/App/Harbour/Repositories/ShipRepository.cs": "public class ShipRepository : IShipRepository { void Q() { _db.Set<Ship>(); _db.Fleet.Where(x); Dock d; } }\n",
    "back/App/Harbour/Repositories/IShipRepository.cs": "public interface IShipRepository { Ship Find(); }\n",
    "back/App/Harbour/Handlers/TideHelper.cs": "class TideHelper { Ship s; }\n",
    "back/App/Harbour/Clocks/SunClient.cs": "class SunClient : IClock { }\n",
    "back/App/Harbour/Clocks/MoonClient.cs": "class MoonClient : IClock { Crew crew; }\n",
    "back/Core/Base/IRepository.cs": "public interface IRepository<T> { }\n",
    "front/config/urls.ts": "export const SHIPS = '/api/ships'\nexport const TIDES = `/api/tides`\nconst INNER = '/api/inner'\n",
    "front/other/urls.ts": "export const TIDES = '/api/moon'\nexport const CREW = '/api/crew'\n",
    "front/features/dock/services/dock.ts": "import { SHIPS as S, TIDES } from '@/config/urls'\nimport { CREW } from '@/config/urls'\nfetch(S)\nfetch(`${S}/${id}/crew`, { method: 'POST' })\nfetch(TIDES)\nfetch(CREW)\nfetch('/api/v3/kept')\nfetch('/api/health/x')\nfetch(unknown)\n",
    "front/features/dock/services/base.ts": "import { SHIPS } from '@/config/urls'\nfetch(`${baseUrl}/deep`)\n",
    "front/lib/http.ts": "export const clean = (u) => u.replace(/^\\/api\\//, '/api/v2/')\n",
    "front/features/dock/pages/Dock.tsx": "export const Dock = () => { const [a, setA] = useState(0); const handleMoor = async () => { await shipService.moor(); setA(1) }; return null }\n",
}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return scan_graph(spark, str(root), Project(aliases=(("@/", "front/"),)))


def short(name):
    return name.split("/")[-1].removesuffix(".cs")


def test_roles_of_files(graph):
    got = {short(r.id): (r.type, r.layer) for r in graph.nodes.filter("path like 'back/%'").collect()}
    assert got["HarbourDb"] == ("data-context", "backend-repository") and got["MoorShipCommandHandler"] == ("handler", "application-handler")
    assert got["ShipRepository"] == ("repository", "backend-repository") and got["IShipRepository"] == ("auxiliary", "auxiliary")
    assert got["TideHelper"] == ("auxiliary", "auxiliary") and got["SunClient"] == ("service", "backend-service") and got["MoorShipCommand"] == ("command", "application-request")


def test_usages_by_the_strongest_evidence(graph):
    got = {(short(r.path), r.entity): (r.reason, r.confidence, r.persistent) for r in graph.usages.collect()}
    assert got == {
        ("MoorShipCommandHandler", "Ship"): ("repository Ship", "high", True), ("MoorShipCommandHandler", "Dock"): ("ORM Set<Dock>", "high", True), ("MoorShipCommandHandler", "Crew"): ("entity Crew", "medium", False),
        ("ShipRepository", "Ship"): ("DbSet Fleet", "high", True), ("ShipRepository", "Dock"): ("entity Dock", "medium", False), ("MoonClient", "Crew"): ("entity Crew", "medium", False),
    }


def test_edges_to_entities_tables_and_logical_nodes(graph):
    got = {(short(r.src), r.type, short(r.dst), r.confidence) for r in graph.edges.filter("type in ('uses-entity', 'queries-table', 'depends-on')").collect()}
    ships, clock = "backend-repository:harbour:IRepository<Ship>".replace("harbour", "Harbour"), "backend-service:Harbour:IClock"
    assert got == {
        ("MoorShipCommandHandler", "uses-entity", "entity:Ship", "high"), ("MoorShipCommandHandler", "queries-table", "table:ships", "high"), ("MoorShipCommandHandler", "uses-entity", "entity:Dock", "high"), ("MoorShipCommandHandler", "queries-table", "table:Docks", "high"),
        ("MoorShipCommandHandler", "uses-entity", "entity:Crew", "medium"), ("ShipRepository", "uses-entity", "entity:Ship", "high"), ("ShipRepository", "queries-table", "table:ships", "high"), ("ShipRepository", "uses-entity", "entity:Dock", "medium"), ("MoonClient", "uses-entity", "entity:Crew", "medium"),
        ("MoorShipCommandHandler", "depends-on", ships, "medium"), ("MoorShipCommandHandler", "depends-on", clock, "medium"), (ships, "uses-entity", "entity:Ship", "high"), (ships, "queries-table", "table:ships", "high"),
    }
    logical = {r.id: (r.label, r.type, r.layer, r.path) for r in graph.nodes.filter("id like 'backend-%'").collect()}
    assert logical == {ships: ("IRepository<Ship>", "repository", "backend-repository", None), clock: ("IClock", "service", "backend-service", None)}


def test_endpoints_through_names_of_other_files(graph):
    got = {(short(r.src), r.dst) for r in graph.edges.filter("type = 'calls-api'").collect()}
    assert got == {
        ("dock.ts", "endpoint:GET /api/v2/ships"), ("dock.ts", "endpoint:POST /api/v2/ships/{}/crew"), ("dock.ts", "endpoint:GET /api/v2/tides"), ("dock.ts", "endpoint:GET /api/v2/crew"),
        ("dock.ts", "endpoint:GET /api/v3/kept"), ("dock.ts", "endpoint:GET /api/health/x"), ("base.ts", "endpoint:GET /api/v2/ships/deep"),
    }


def test_reviews_of_what_should_only_compose(graph):
    assert [(short(r.path), r.type, r.signals) for r in graph.reviews.collect()] == [("Dock.tsx", "page", ["hooks", "handlers", "async", "api/service/repository calls", "state updates"])]
    assert graph.warnings == []


@pytest.mark.parametrize(
    ("source", "found"),
    [
        ("type X = any;", [": any"]), ("type A = any[]", [": any"]), ("let f: () => any", [": any"]), ("function f<T = any>() {}", [": any"]), ("type K = keyof any", [": any"]), ("type B = A extends any ? 1 : 2", [": any"]),
        ("let x: any = 1", [": any"]), ("x as any", ["as any"]), ("const a: Array<any> = []", ["Array<any>"]), ("const y = <any>z", ["<any>"]), ("const g = (a: any, b?: any): any => a", [": any"] * 3), ("type T = { a: any, b: [any, any] }", [": any"] * 3),
        ("const m: Record<string, any> = {}", [": any"]), ("any.foo()", []), ("const any = 1", []), ("f(any)", []), ("const o = { any: 1 }", []), ("x ? any : y", []), ("'any' // any", []),
    ],
)
def test_every_form_of_any(source, found):
    assert [how for how, _ in lex.any_types(source)] == found


def test_facts_of_bindings():
    assert lex.exported_bindings("export const A = '/api/a', B = `/api/b/${x}`\nexport const C: string = '/other'\nconst D = '/api/d'\nfunction f() { }\nexport let E = '/api/e';") == [("A", "/api/a"), ("B", "/api/b/${x}"), ("E", "/api/e")]
    assert lex.named_imports("import X, { A as B, type C } from './m'\nimport * as Q from 'q'") == [("./m", "A", "B"), ("./m", "C", "C")]
    assert lex.version_prefix("u.replace('/api/', '/api/v2/'); u.replace(/x/, '/api/v2/'); u.replace(/[/]api[/]/g, '/api/v7/')") == "/api/v7/"
    assert lex.dispatched_requests("class C { Task A(GetShipQuery q, CancellationToken t) => m.Send(new AddCommand(1)); object x = (OldQuery) y; }") == ["GetShipQuery", "AddCommand"]
    assert lex.injected_types("class H(IRepository<Ship> ships, [From] ILogger<H> log, int n) { public H(Map<string, List<Ship>> x = null) {} }") == [("IRepository", "IRepository<Ship>", ["Ship"]), ("ILogger", "ILogger<H>", ["H"]), ("Map", "Map<string, List<Ship>>", ["string", "List", "Ship"])]


def test_fragments_decide_in_their_order(spark):
    from pyspark.sql import functions as F

    from graphloom.operators import rules

    want = {"front/x/types/schemas/a.ts": "auxiliary", "front/x/stores/schemas/a.ts": "auxiliary", "front/x/schemas/utils/a.ts": "config", "front/x/schemas/lib/a.ts": "config", "front/x/config/types/a.ts": "config", "front/x/repositories/config/a.ts": "repository"}
    rows = spark.createDataFrame([(p,) for p in want], "path string").select("path", rules.classify_front(F.col("path")).getField("type").alias("t"))
    assert {r.path: r.t for r in rows.collect()} == want
