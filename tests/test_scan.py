from graphloom.operators.guardrails import Options
from graphloom.plans.scan import Project, scan_graph

TREE = {
    "front/features/cart/components/Cart.tsx": "import { useCart } from '../hooks/useCart'\nimport { api } from '@/lib/api'\nconst page = import('./Later')\n",
    "front/features/cart/components/Later.tsx": "export const x = 1\n",
    "front/features/cart/hooks/useCart.ts": "export const useCart = () => fetch('/api/carts', { method: 'POST' })\n",
    "front/lib/api.ts": "export const api = 1\n",
    "front/features/cart/hooks/useCart.test.ts": "import { useCart } from './useCart'\nit('a', f)\ntest('b', f)\n",
    "back/Api/Controllers/CartsController.cs": '[Route("api/carts")]\npublic class CartsController : ControllerBase { [HttpPost] public object Add() => Ok(); }\n',
}


def test_scan_of_a_tree(spark, tmp_path):
    for name, text in TREE.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    g = scan_graph(spark, str(tmp_path), Project(aliases=(("@/", "front/"),), suppressions=({"path": "front/features/**", "reason": "old"},)))
    kinds = {r.id: (r.type, r.module) for r in g.nodes.collect()}
    assert kinds["file:front/features/cart/hooks/useCart.ts"] == ("hook", "cart") and kinds["file:back/Api/Controllers/CartsController.cs"] == ("controller", "carts")
    assert "file:front/features/cart/hooks/useCart.test.ts" not in kinds and kinds["endpoint:POST /api/carts"][0] == "endpoint"
    edges = {(r.src.split("/")[-1], r.type, r.dst.split("/")[-1]) for r in g.edges.collect()}
    assert edges == {
        ("Cart.tsx", "imports", "useCart.ts"), ("Cart.tsx", "imports", "api.ts"), ("Cart.tsx", "lazy-imports", "Later.tsx"),
        ("useCart.ts", "calls-api", "carts"), ("carts", "resolved-controller", "CartsController.cs"),
    }
    assert [(r.source.split("/")[-1], r.n_cases) for r in g.coverage.collect()] == [("useCart.ts", 2)]
    assert {(r.rule_id.split(".")[-1], r.suppressed) for r in g.findings.collect()} == {("relative-imports", True)}
    assert [r.label for r in g.orphans.collect()] == ["Cart.tsx"]
    assert {r.id.split("/")[-1] for r in g.quality.collect()} == {"Cart.tsx", "Later.tsx", "useCart.ts", "CartsController.cs"}


BACK = {
    "back/Api/Sales/Controllers/SalesController.cs": '[Route("api/sales")]\npublic class SalesController : ControllerBase\n{ [HttpPost] public Task Add() { foreach (var x in y) {} return m.Send(new AddSaleCommand()); } }\n',
    "back/App/Sales/Commands/AddSaleCommand.cs": "public record AddSaleCommand(int Id);\n",
    "back/App/Sales/Handlers/AddSaleCommandHandler.cs": "public class AddSaleCommandHandler(ISaleStore store) { void H() { s.Send(new AddSaleCommand()); s.Send(new AuditQuery()); } }\n",
    "back/App/Audit/Queries/AuditQuery.cs": "public class AuditQuery {}\n",
    "back/App/Sales/Stores/SaleStore.cs": "public class SaleStore : ISaleStore { public SaleStore(ShopDb db) {} }\n",
    "back/App/Sales/Stores/ISaleStore.cs": "public interface ISaleStore {}\n",
    "back/Data/Shop/ShopDb.cs": "public class ShopDb : DbContext { public DbSet<Sale> Sales { get; set; } public DbSet<Item> Things { get; set; } }\n",
    "back/Domain/Sales/Entities/Sale.cs": "public class Sale { public List<Item> Items { get; set; } }\n",
    "back/Domain/Sales/Entities/Item.cs": "public class Item { public int Id { get; set; } }\n",
    "back/Data/Shop/SaleMap.cs": 'class SaleMap : IEntityTypeConfiguration<Sale> { void C(B b) { b.ToTable("sale_rows"); } }\n',
}


def test_scan_of_a_backend(spark, tmp_path):
    for name, text in BACK.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    g = scan_graph(spark, str(tmp_path))
    short = lambda x: x.split("/")[-1].removesuffix(".cs")
    edges = {(short(r.src), r.type, short(r.dst)) for r in g.edges.collect()}
    assert edges == {
        ("sales", "resolved-controller", "SalesController"), ("SalesController", "sends", "AddSaleCommand"), ("AddSaleCommandHandler", "sends", "AuditQuery"), ("AddSaleCommand", "handled-by", "AddSaleCommandHandler"),
        ("AddSaleCommandHandler", "depends-on", "SaleStore"), ("SaleStore", "depends-on", "ShopDb"), ("ShopDb", "dbset", "entity:Sale"), ("ShopDb", "dbset", "entity:Item"),
        ("entity:Sale", "maps-to-table", "table:sale_rows"), ("entity:Item", "maps-to-table", "table:Things"), ("entity:Sale", "domain-relation", "entity:Item"),
    }
    assert [(r.rule_id, r.line, r.evidence) for r in g.findings.collect()] == [("architecture.mvc.thin-controller", 3, "loop in controller action")]


RULED = {
    "front/features/cart/components/CartMain/index.tsx": "import { T } from '@/features/shop/types'\nimport { S } from '@/features/shop/inner'\nexport const CartMain = () => { const [a, b] = useState(0); fetch('/api/x'); useEffect(f); return null }\n",
    "front/features/cart/components/Plain.tsx": "export const Plain = () => null\n",
    "front/features/cart/repositories/cart.ts": "import React from 'react'\nimport { x } from '@/lib/x'\n",
    "back/Shop.Domain/Cart.cs": "using System;\nusing Shop.API.Web;\nusing Z = Shop.API.Deep;\nnamespace Shop.Domain { class Cart { void M() { using var s = Open(); } } }\n",
    "back/Shop.API/Cart.cs": "using Shop.Domain;\n",
}


def test_architecture_rules(spark, tmp_path):
    for name, text in RULED.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = scan_graph(spark, str(tmp_path), Project(guardrails=Options(namespace_prefix="Shop"))).findings.collect()
    got = {(r.rule_id.split(".")[-1], r.path.split("/")[-1], r.line, r.evidence) for r in found}
    assert got == {
        ("thin-view-entry", "index.tsx", 3, "React orchestration hook"), ("thin-view-entry", "index.tsx", 3, "API/service/repository access"), ("viewmodel-hook-naming", "index.tsx", 1, "useCartMain"),
        ("no-cross-feature-internals", "index.tsx", 2, "@/features/shop/inner"), ("component-folder-entry", "Plain.tsx", 1, "Plain.tsx"),
        ("no-ui-imports-in-data-adapters", "cart.ts", 1, "react"), ("layer-boundaries", "Cart.cs", 2, "using Shop.API"),
    }
