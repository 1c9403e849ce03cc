"""Rows that the queries over small projects gave and that were then checked against their sources by reading, as literal SQL."""

from __future__ import annotations


def rows(columns: str, *values: str) -> str:
    """SQL for literal rows; columns are `name TYPE` each."""
    cast = ", ".join(f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in columns.split(", "))
    names = ", ".join(c.split()[0] for c in columns.split(", "))
    return f"SELECT {cast} FROM (VALUES {', '.join(f'({v})' for v in values)}) t({names})"


ROWS: dict[str, str] = {
    "extract_facts": rows(
        "path VARCHAR, fact_kind VARCHAR, kind VARCHAR, name VARCHAR, target VARCHAR, start_line INTEGER, end_line INTEGER",
        "'cmd/main.go', 'call', 'call', 'helper', NULL, 5, 5",
        "'cmd/main.go', 'entrypoint', 'main', 'main', NULL, 5, 5",
        "'cmd/main.go', 'reference', 'call', 'helper', 'helper', 5, 5",
        "'cmd/main.go', 'unit', 'file', 'cmd::main', NULL, 1, 1",
        "'cmd/main.go', 'unit', 'function', 'cmd::main::helper', NULL, 3, 3",
        "'cmd/main.go', 'unit', 'function', 'cmd::main::main', NULL, 5, 5",
        "'src/broken.py', 'diagnostic', 'warning', 'PARSE_ERROR', 'invalid syntax (<unknown>, line 1)', 1, 1",
        "'src/broken.py', 'unit', 'file', 'src::broken', NULL, 1, 1",
        "'src/orders/api.py', 'binding', 'constructor', 'app', 'FastAPI', 4, 4",
        "'src/orders/api.py', 'binding', 'constructor', 'store', 'Store', 9, 9",
        "'src/orders/api.py', 'binding', 'import', 'FastAPI', 'fastapi.FastAPI', 1, 1",
        "'src/orders/api.py', 'binding', 'import', 'Store', 'src.orders.store.Store', 2, 2",
        "'src/orders/api.py', 'call', 'call', 'FastAPI', NULL, 4, 4",
        "'src/orders/api.py', 'call', 'call', 'Store', NULL, 21, 21",
        "'src/orders/api.py', 'call', 'call', 'Store', NULL, 9, 9",
        "'src/orders/api.py', 'call', 'call', 'ValueError', NULL, 16, 16",
        "'src/orders/api.py', 'call', 'call', '[dynamic].save', NULL, 21, 21",
        "'src/orders/api.py', 'call', 'call', 'save_order', NULL, 17, 17",
        "'src/orders/api.py', 'call', 'call', 'store.load', NULL, 10, 10",
        "'src/orders/api.py', 'decorator', 'decorator', 'app.get', NULL, 7, 7",
        "'src/orders/api.py', 'decorator', 'decorator', 'app.post', NULL, 13, 13",
        "'src/orders/api.py', 'entrypoint', 'http', 'create', NULL, 13, 13",
        "'src/orders/api.py', 'entrypoint', 'http', 'read', NULL, 7, 7",
        "'src/orders/api.py', 'reference', 'call', 'FastAPI', 'FastAPI', 4, 4",
        "'src/orders/api.py', 'reference', 'call', 'Store', 'Store', 21, 21",
        "'src/orders/api.py', 'reference', 'call', 'Store', 'Store', 9, 9",
        "'src/orders/api.py', 'reference', 'call', 'ValueError', 'ValueError', 16, 16",
        "'src/orders/api.py', 'reference', 'call', '[dynamic].save', '[dynamic].save', 21, 21",
        "'src/orders/api.py', 'reference', 'call', 'save_order', 'save_order', 17, 17",
        "'src/orders/api.py', 'reference', 'call', 'store.load', 'store.load', 10, 10",
        "'src/orders/api.py', 'reference', 'import', 'fastapi', 'fastapi', 1, 1",
        "'src/orders/api.py', 'reference', 'import', 'src.orders.store', 'src.orders.store', 2, 2",
        "'src/orders/api.py', 'unit', 'file', 'src::orders::api', NULL, 1, 1",
        "'src/orders/api.py', 'unit', 'function', 'src::orders::api::create', NULL, 14, 17",
        "'src/orders/api.py', 'unit', 'function', 'src::orders::api::read', NULL, 8, 10",
        "'src/orders/api.py', 'unit', 'function', 'src::orders::api::save_order', NULL, 20, 21",
        "'src/orders/store.py', 'call', 'call', 'eval', NULL, 15, 15",
        "'src/orders/store.py', 'call', 'call', 'print', NULL, 17, 17",
        "'src/orders/store.py', 'call', 'call', 'self.check', NULL, 8, 8",
        "'src/orders/store.py', 'call', 'call', 'self.run', NULL, 3, 3",
        "'src/orders/store.py', 'call', 'call', 'self.run', NULL, 7, 7",
        "'src/orders/store.py', 'call', 'call', 'self.save', NULL, 11, 11",
        "'src/orders/store.py', 'reference', 'call', 'eval', 'eval', 15, 15",
        "'src/orders/store.py', 'reference', 'call', 'print', 'print', 17, 17",
        "'src/orders/store.py', 'reference', 'call', 'self.check', 'self.check', 8, 8",
        "'src/orders/store.py', 'reference', 'call', 'self.run', 'self.run', 3, 3",
        "'src/orders/store.py', 'reference', 'call', 'self.run', 'self.run', 7, 7",
        "'src/orders/store.py', 'reference', 'call', 'self.save', 'self.save', 11, 11",
        "'src/orders/store.py', 'resource', 'table', 'order_lines', NULL, 7, 7",
        "'src/orders/store.py', 'resource', 'table', 'orders', NULL, 3, 3",
        "'src/orders/store.py', 'unit', 'class', 'src::orders::store::Store', NULL, 1, 17",
        "'src/orders/store.py', 'unit', 'file', 'src::orders::store', NULL, 1, 1",
        "'src/orders/store.py', 'unit', 'method', 'src::orders::store::Store::check', NULL, 10, 11",
        "'src/orders/store.py', 'unit', 'method', 'src::orders::store::Store::load', NULL, 2, 3",
        "'src/orders/store.py', 'unit', 'method', 'src::orders::store::Store::run', NULL, 13, 17",
        "'src/orders/store.py', 'unit', 'method', 'src::orders::store::Store::save', NULL, 5, 8",
        "'web/client.ts', 'binding', 'import', 'get', './http.get', 1, 1",
        "'web/client.ts', 'call', 'call', 'bus.on', NULL, 6, 6",
        "'web/client.ts', 'call', 'call', 'get', NULL, 3, 3",
        "'web/client.ts', 'call', 'call', 'router.get', NULL, 5, 5",
        "'web/client.ts', 'entrypoint', 'http', '/health', NULL, 5, 5",
        "'web/client.ts', 'reference', 'call', 'bus.on', 'bus.on', 6, 6",
        "'web/client.ts', 'reference', 'call', 'get', 'get', 3, 3",
        "'web/client.ts', 'reference', 'call', 'router.get', 'router.get', 5, 5",
        "'web/client.ts', 'reference', 'import', './http', './http', 1, 1",
        "'web/client.ts', 'unit', 'file', 'web::client', NULL, 1, 1",
        "'web/client.ts', 'unit', 'function', 'web::client::loadOrder', NULL, 2, 4",
        "'web/http.ts', 'call', 'call', 'fetch', NULL, 1, 1",
        "'web/http.ts', 'reference', 'call', 'fetch', 'fetch', 1, 1",
        "'web/http.ts', 'unit', 'file', 'web::http', NULL, 1, 1",
        "'web/http.ts', 'unit', 'function', 'web::http::get', NULL, 1, 1",
    ),
    "control_facts": rows(
        "owner VARCHAR, kind VARCHAR, condition VARCHAR, start_line INTEGER, end_line INTEGER",
        "'cmd::main::helper', 'return', 'a', 3, 3",
        "'src::orders::api::create', 'branch', 'not body', 15, 16",
        "'src::orders::api::create', 'return', 'save_order(body)', 17, 17",
        "'src::orders::api::create', 'throw', 'ValueError(''empty'')', 16, 16",
        "'src::orders::api::read', 'return', 'store.load(id)', 10, 10",
        "'src::orders::api::save_order', 'return', 'Store().save(body)', 21, 21",
        "'src::orders::store::Store::check', 'return', 'body and self.save(body[1:])', 11, 11",
        "'src::orders::store::Store::load', 'return', 'self.run(''SELECT * FROM orders WHERE id = 1'')', 3, 3",
        "'src::orders::store::Store::run', 'return', 'eval(sql)', 15, 15",
        "'src::orders::store::Store::run', 'try', NULL, 14, 17",
        "'src::orders::store::Store::save', 'loop', 'body', 6, 7",
        "'src::orders::store::Store::save', 'return', 'self.check(body)', 8, 8",
        "'web::client::loadOrder', 'return', 'await get(''/api/v1/orders/'' + id)', 3, 3",
        "'web::http::get', 'return', 'fetch(path)', 1, 1",
    ),
    "unit_details": rows(
        "project VARCHAR, qualified_name VARCHAR, kind VARCHAR, parameters VARCHAR, bases VARCHAR, returns VARCHAR, visibility VARCHAR",
        "'ecma', 'router::serve', 'function', NULL, NULL, NULL, 'unknown'",
        "'ecma', 'routes::items::+server::GET', 'function', NULL, NULL, NULL, NULL",
        "'ecma', 'server::api::users::GET', 'function', NULL, NULL, NULL, 'public'",
        "'ecma', 'server::api::users::GET::<lambda@2:51>', 'lambda', NULL, NULL, NULL, NULL",
        "'go', 'routes::serve', 'function', NULL, NULL, NULL, 'private'",
        "'go', 'routes::wire', 'function', NULL, NULL, NULL, 'private'",
        "'native', 'native::MainWindow', 'class', NULL, 'CWinApp', NULL, 'unknown'",
        "'native', 'native::Monster', 'class', NULL, 'AActor', NULL, 'unknown'",
        "'native', 'program::Panel', 'class', NULL, 'ComponentBase', NULL, 'unknown'",
        "'native', 'program::Program', 'class', NULL, NULL, NULL, 'unknown'",
        "'native', 'program::Program::Setup', 'method', 'app', NULL, 'void', 'unknown'",
        "'native', 'program::Program::Show', 'method', NULL, NULL, 'void', 'unknown'",
        "'native', 'program::Start', 'class', NULL, 'ContentPage', NULL, 'unknown'",
        "'native', 'widget::Panel', 'struct', NULL, NULL, NULL, 'unknown'",
        "'polyglot', 'Cart::Cart', 'class', NULL, NULL, NULL, 'unknown'",
        "'polyglot', 'Cart::Cart::lines', 'method', NULL, NULL, 'void', 'unknown'",
        "'polyglot', 'Stock::Stock', 'class', NULL, NULL, NULL, 'unknown'",
        "'polyglot', 'Stock::Stock::parts', 'method', NULL, NULL, 'void', 'unknown'",
        "'polyglot', 'axum::build', 'function', NULL, NULL, NULL, 'private'",
        "'polyglot', 'axum::serve', 'function', NULL, NULL, NULL, 'private'",
        "'polyglot', 'shelf::serve', 'function', NULL, NULL, 'void', 'public'",
        "'polyglot', 'shelf::setup', 'function', 'router', NULL, 'void', 'public'",
        "'polyglot', 'site::front', 'function', 'request', NULL, NULL, NULL",
        "'routers', 'Pages::ReportController', 'class', NULL, 'Controller', NULL, 'public'",
        "'routers', 'Pages::ReportController::Hidden', 'method', NULL, NULL, 'void', 'private'",
        "'routers', 'Pages::ReportController::Index', 'method', NULL, NULL, 'string', 'public'",
        "'routers', 'Pages::ReportController::Own', 'method', NULL, NULL, 'string', 'public'",
        "'routers', 'shop::carts::open_carts', 'function', '', NULL, NULL, NULL",
        "'routers', 'shop::roles::add', 'function', 'body', NULL, NULL, NULL",
        "'routers', 'shop::users::read', 'function', 'id', NULL, NULL, NULL",
        "'routers', 'todo::Todos', 'class', NULL, NULL, NULL, 'unknown'",
        "'routers', 'todo::Todos::list', 'method', 'q', NULL, 'METHOD_LIST_END void', 'unknown'",
        "'routers', 'todo::Todos::list', 'method', 'q', NULL, 'void', 'unknown'",
        "'shop', 'cmd::main::helper', 'function', 'a', NULL, 'int', 'private'",
        "'shop', 'cmd::main::main', 'function', NULL, NULL, NULL, 'private'",
        "'shop', 'src::orders::api::create', 'function', 'body', NULL, NULL, NULL",
        "'shop', 'src::orders::api::read', 'function', 'id', NULL, NULL, NULL",
        "'shop', 'src::orders::api::save_order', 'function', 'body', NULL, NULL, NULL",
        "'shop', 'src::orders::store::Store', 'class', NULL, NULL, NULL, NULL",
        "'shop', 'src::orders::store::Store::check', 'method', 'self, body', NULL, NULL, NULL",
        "'shop', 'src::orders::store::Store::load', 'method', 'self, id', NULL, NULL, NULL",
        "'shop', 'src::orders::store::Store::run', 'method', 'self, sql', NULL, NULL, NULL",
        "'shop', 'src::orders::store::Store::save', 'method', 'self, body', NULL, NULL, NULL",
        "'shop', 'web::client::loadOrder', 'function', 'id', NULL, NULL, 'public'",
        "'shop', 'web::http::get', 'function', 'path', NULL, NULL, 'public'",
    ),
    "analyze_domains": rows(
        "bucket VARCHAR, packets BIGINT, status VARCHAR, level VARCHAR, score INTEGER",
        "'orders', 2, 'candidate', 'medium', 55",
        "'web', 1, 'candidate', 'medium', 35",
    ),
    "analyze_references": rows(
        "file_id VARCHAR, kind VARCHAR, target_name VARCHAR, qualified_name VARCHAR, status VARCHAR, start_line INTEGER",
        "'f1', 'call', 'FastAPI', NULL, 'unknown', 4",
        "'f1', 'call', 'Store', 'src::orders::store::Store', 'confirmed', 21",
        "'f1', 'call', 'Store', 'src::orders::store::Store', 'confirmed', 9",
        "'f1', 'call', 'ValueError', NULL, 'unknown', 16",
        "'f1', 'call', '[dynamic].save', NULL, 'dynamic', 21",
        "'f1', 'call', 'save_order', 'src::orders::api::save_order', 'confirmed', 17",
        "'f1', 'call', 'store.load', 'src::orders::store::Store::load', 'confirmed', 10",
        "'f1', 'import', 'fastapi', NULL, 'unknown', 1",
        "'f1', 'import', 'src.orders.store', 'src::orders::store', 'confirmed', 2",
        "'f2', 'call', 'eval', NULL, 'dynamic', 15",
        "'f2', 'call', 'print', NULL, 'unknown', 17",
        "'f2', 'call', 'self.check', 'src::orders::store::Store::check', 'confirmed', 8",
        "'f2', 'call', 'self.run', 'src::orders::store::Store::run', 'confirmed', 3",
        "'f2', 'call', 'self.run', 'src::orders::store::Store::run', 'confirmed', 7",
        "'f2', 'call', 'self.save', 'src::orders::store::Store::save', 'confirmed', 11",
        "'f3', 'call', 'bus.on', NULL, 'unknown', 6",
        "'f3', 'call', 'get', 'web::http::get', 'confirmed', 3",
        "'f3', 'call', 'router.get', NULL, 'unknown', 5",
        "'f3', 'import', './http', 'web::http', 'confirmed', 1",
        "'f4', 'call', 'fetch', NULL, 'unknown', 1",
        "'f5', 'call', 'helper', 'cmd::main::helper', 'confirmed', 5",
    ),
    "analyze_features": rows(
        "feature VARCHAR, key VARCHAR, label VARCHAR, kind VARCHAR, status VARCHAR, level VARCHAR, domain_ids VARCHAR[], resolved BIGINT, unresolved BIGINT, dynamic BIGINT, reachable BIGINT, resources INTEGER, boundaries INTEGER",
        "'GET:/health', 'health', 'Health', 'endpoint', 'candidate', 'medium', ['web'], 1, 1, 0, 2, 0, 0",
        "'GET:/orders/:param', 'orders', 'Orders', 'endpoint', 'candidate', 'medium', ['orders'], 3, 2, 1, 4, 1, 1",
        "'POST:/orders', 'orders', 'Orders', 'endpoint', 'candidate', 'medium', ['orders'], 2, 2, 1, 3, 0, 1",
    ),
    "operation_features": rows(
        "feature VARCHAR, key VARCHAR, kind VARCHAR, status VARCHAR, level VARCHAR, reachable BIGINT",
        "'lib::sum::sum', 'sum', 'operation', 'candidate', 'high', 2",
    ),
    "cfg_edges": rows(
        "owner VARCHAR, source_kind VARCHAR, source_label VARCHAR, target_kind VARCHAR, target_label VARCHAR, kind VARCHAR, label VARCHAR",
        "'cmd::main::helper', 'entry', '', 'return', 'return', 'sequential', ''",
        "'cmd::main::helper', 'return', 'return', 'exit', '', 'return', ''",
        "'cmd::main::main', 'call', 'helper', 'exit', '', 'sequential', ''",
        "'cmd::main::main', 'entry', '', 'call', 'helper', 'sequential', ''",
        "'src::orders::api::create', 'call', 'ValueError', 'throw', 'throw', 'sequential', ''",
        "'src::orders::api::create', 'call', 'save_order', 'exit', '', 'return', ''",
        "'src::orders::api::create', 'condition', 'not body', 'call', 'ValueError', 'trueBranch', ''",
        "'src::orders::api::create', 'condition', 'not body', 'return', 'return', 'falseBranch', ''",
        "'src::orders::api::create', 'entry', '', 'condition', 'not body', 'sequential', ''",
        "'src::orders::api::create', 'return', 'return', 'call', 'save_order', 'sequential', 'return-value'",
        "'src::orders::api::create', 'throw', 'throw', 'exit', '', 'exception', 'catch'",
        "'src::orders::api::read', 'call', 'Store', 'return', 'return', 'sequential', ''",
        "'src::orders::api::read', 'call', 'store.load', 'exit', '', 'return', ''",
        "'src::orders::api::read', 'entry', '', 'call', 'Store', 'sequential', ''",
        "'src::orders::api::read', 'return', 'return', 'call', 'store.load', 'sequential', 'return-value'",
        "'src::orders::api::save_order', 'call', 'Store', 'dynamicBoundary', '[dynamic].save', 'sequential', ''",
        "'src::orders::api::save_order', 'dynamicBoundary', '[dynamic].save', 'exit', '', 'return', ''",
        "'src::orders::api::save_order', 'entry', '', 'return', 'return', 'sequential', ''",
        "'src::orders::api::save_order', 'return', 'return', 'call', 'Store', 'sequential', 'return-value'",
        "'src::orders::store::Store::check', 'call', 'self.save', 'exit', '', 'return', ''",
        "'src::orders::store::Store::check', 'condition', '&&', 'call', 'self.save', 'trueBranch', ''",
        "'src::orders::store::Store::check', 'condition', '&&', 'exit', '', 'return', ''",
        "'src::orders::store::Store::check', 'entry', '', 'return', 'return', 'sequential', ''",
        "'src::orders::store::Store::check', 'return', 'return', 'condition', '&&', 'sequential', 'return-value'",
        "'src::orders::store::Store::load', 'call', 'self.run', 'exit', '', 'return', ''",
        "'src::orders::store::Store::load', 'entry', '', 'return', 'return', 'sequential', ''",
        "'src::orders::store::Store::load', 'return', 'return', 'call', 'self.run', 'sequential', 'return-value'",
        "'src::orders::store::Store::run', 'call', 'print', 'exit', '', 'return', ''",
        "'src::orders::store::Store::run', 'condition', 'try', 'return', 'return', 'sequential', 'try'",
        "'src::orders::store::Store::run', 'dynamicBoundary', 'eval', 'call', 'print', 'sequential', 'finally'",
        "'src::orders::store::Store::run', 'entry', '', 'condition', 'try', 'sequential', ''",
        "'src::orders::store::Store::run', 'return', 'return', 'dynamicBoundary', 'eval', 'sequential', 'return-value'",
        "'src::orders::store::Store::save', 'call', 'self.check', 'exit', '', 'return', ''",
        "'src::orders::store::Store::save', 'call', 'self.run', 'loop', 'body', 'loopBack', ''",
        "'src::orders::store::Store::save', 'entry', '', 'loop', 'body', 'sequential', ''",
        "'src::orders::store::Store::save', 'loop', 'body', 'call', 'self.run', 'loopBody', ''",
        "'src::orders::store::Store::save', 'loop', 'body', 'return', 'return', 'falseBranch', ''",
        "'src::orders::store::Store::save', 'return', 'return', 'call', 'self.check', 'sequential', 'return-value'",
        "'web::client::loadOrder', 'call', 'get', 'exit', '', 'return', ''",
        "'web::client::loadOrder', 'entry', '', 'return', 'return', 'sequential', ''",
        "'web::client::loadOrder', 'return', 'return', 'call', 'get', 'sequential', 'return-value'",
        "'web::http::get', 'call', 'fetch', 'exit', '', 'return', ''",
        "'web::http::get', 'entry', '', 'return', 'return', 'sequential', ''",
        "'web::http::get', 'return', 'return', 'call', 'fetch', 'sequential', 'return-value'",
    ),
    "flow_nodes": rows(
        "owner VARCHAR, kind VARCHAR, label VARCHAR, line INTEGER, target VARCHAR",
        "'cmd::main::helper', 'entry', '', 0, NULL",
        "'cmd::main::helper', 'exit', '', 0, NULL",
        "'cmd::main::helper', 'return', 'return', 3, NULL",
        "'cmd::main::main', 'call', 'helper', 5, 'cmd::main::helper'",
        "'cmd::main::main', 'entry', '', 0, NULL",
        "'cmd::main::main', 'exit', '', 0, NULL",
        "'src::orders::api::create', 'call', 'ValueError', 16, NULL",
        "'src::orders::api::create', 'call', 'save_order', 17, 'src::orders::api::save_order'",
        "'src::orders::api::create', 'condition', 'not body', 15, NULL",
        "'src::orders::api::create', 'entry', '', 0, NULL",
        "'src::orders::api::create', 'exit', '', 0, NULL",
        "'src::orders::api::create', 'return', 'return', 17, NULL",
        "'src::orders::api::create', 'throw', 'throw', 16, NULL",
        "'src::orders::api::read', 'call', 'Store', 9, 'src::orders::store::Store'",
        "'src::orders::api::read', 'call', 'store.load', 10, 'src::orders::store::Store::load'",
        "'src::orders::api::read', 'entry', '', 0, NULL",
        "'src::orders::api::read', 'exit', '', 0, NULL",
        "'src::orders::api::read', 'return', 'return', 10, NULL",
        "'src::orders::api::save_order', 'call', 'Store', 21, 'src::orders::store::Store'",
        "'src::orders::api::save_order', 'dynamicBoundary', '[dynamic].save', 21, NULL",
        "'src::orders::api::save_order', 'entry', '', 0, NULL",
        "'src::orders::api::save_order', 'exit', '', 0, NULL",
        "'src::orders::api::save_order', 'return', 'return', 21, NULL",
        "'src::orders::store::Store::check', 'call', 'self.save', 11, 'src::orders::store::Store::save'",
        "'src::orders::store::Store::check', 'condition', '&&', 11, NULL",
        "'src::orders::store::Store::check', 'entry', '', 0, NULL",
        "'src::orders::store::Store::check', 'exit', '', 0, NULL",
        "'src::orders::store::Store::check', 'return', 'return', 11, NULL",
        "'src::orders::store::Store::load', 'call', 'self.run', 3, 'src::orders::store::Store::run'",
        "'src::orders::store::Store::load', 'entry', '', 0, NULL",
        "'src::orders::store::Store::load', 'exit', '', 0, NULL",
        "'src::orders::store::Store::load', 'return', 'return', 3, NULL",
        "'src::orders::store::Store::run', 'call', 'print', 17, NULL",
        "'src::orders::store::Store::run', 'condition', 'try', 14, NULL",
        "'src::orders::store::Store::run', 'dynamicBoundary', 'eval', 15, NULL",
        "'src::orders::store::Store::run', 'entry', '', 0, NULL",
        "'src::orders::store::Store::run', 'exit', '', 0, NULL",
        "'src::orders::store::Store::run', 'return', 'return', 15, NULL",
        "'src::orders::store::Store::save', 'call', 'self.check', 8, 'src::orders::store::Store::check'",
        "'src::orders::store::Store::save', 'call', 'self.run', 7, 'src::orders::store::Store::run'",
        "'src::orders::store::Store::save', 'entry', '', 0, NULL",
        "'src::orders::store::Store::save', 'exit', '', 0, NULL",
        "'src::orders::store::Store::save', 'loop', 'body', 6, NULL",
        "'src::orders::store::Store::save', 'return', 'return', 8, NULL",
        "'web::client::loadOrder', 'call', 'get', 3, 'web::http::get'",
        "'web::client::loadOrder', 'entry', '', 0, NULL",
        "'web::client::loadOrder', 'exit', '', 0, NULL",
        "'web::client::loadOrder', 'return', 'return', 3, NULL",
        "'web::http::get', 'call', 'fetch', 1, NULL",
        "'web::http::get', 'entry', '', 0, NULL",
        "'web::http::get', 'exit', '', 0, NULL",
        "'web::http::get', 'return', 'return', 1, NULL",
    ),
    "flow_links": rows(
        "source VARCHAR, target VARCHAR, back VARCHAR, status VARCHAR",
        "'cmd::main::main', 'cmd::main::helper', 'exit', 'confirmed'",
        "'src::orders::api::create', 'src::orders::api::save_order', NULL, 'confirmed'",
        "'src::orders::api::read', 'src::orders::store::Store::load', NULL, 'confirmed'",
        "'src::orders::store::Store::check', 'src::orders::store::Store::save', NULL, 'confirmed'",
        "'src::orders::store::Store::load', 'src::orders::store::Store::run', NULL, 'confirmed'",
        "'src::orders::store::Store::save', 'src::orders::store::Store::check', NULL, 'confirmed'",
        "'src::orders::store::Store::save', 'src::orders::store::Store::run', NULL, 'confirmed'",
        "'web::client::loadOrder', 'web::http::get', NULL, 'confirmed'",
    ),
    "flow_maps": rows(
        "owner VARCHAR, kind VARCHAR, label VARCHAR, status VARCHAR",
        "'cmd::main::helper', 'return', 'return', 'verified'",
        "'cmd::main::main', 'call', 'helper', 'verified'",
        "'src::orders::api::create', 'call', 'ValueError', 'verified'",
        "'src::orders::api::create', 'call', 'save_order', 'verified'",
        "'src::orders::api::create', 'condition', 'not body', 'verified'",
        "'src::orders::api::create', 'return', 'return', 'verified'",
        "'src::orders::api::create', 'throw', 'throw', 'verified'",
        "'src::orders::api::read', 'call', 'Store', 'verified'",
        "'src::orders::api::read', 'call', 'store.load', 'verified'",
        "'src::orders::api::read', 'return', 'return', 'verified'",
        "'src::orders::api::save_order', 'call', 'Store', 'verified'",
        "'src::orders::api::save_order', 'dynamicBoundary', '[dynamic].save', 'candidate'",
        "'src::orders::api::save_order', 'return', 'return', 'verified'",
        "'src::orders::store::Store::check', 'call', 'self.save', 'verified'",
        "'src::orders::store::Store::check', 'condition', '&&', 'verified'",
        "'src::orders::store::Store::check', 'return', 'return', 'verified'",
        "'src::orders::store::Store::load', 'call', 'self.run', 'verified'",
        "'src::orders::store::Store::load', 'return', 'return', 'verified'",
        "'src::orders::store::Store::run', 'call', 'print', 'verified'",
        "'src::orders::store::Store::run', 'condition', 'try', 'verified'",
        "'src::orders::store::Store::run', 'dynamicBoundary', 'eval', 'candidate'",
        "'src::orders::store::Store::run', 'return', 'return', 'verified'",
        "'src::orders::store::Store::save', 'call', 'self.check', 'verified'",
        "'src::orders::store::Store::save', 'call', 'self.run', 'verified'",
        "'src::orders::store::Store::save', 'loop', 'body', 'verified'",
        "'src::orders::store::Store::save', 'return', 'return', 'verified'",
        "'web::client::loadOrder', 'call', 'get', 'verified'",
        "'web::client::loadOrder', 'return', 'return', 'verified'",
        "'web::http::get', 'call', 'fetch', 'verified'",
        "'web::http::get', 'return', 'return', 'verified'",
    ),
    "context_flows": rows(
        "owner VARCHAR, features INTEGER, reason VARCHAR, required BOOLEAN, score BIGINT, steps VARCHAR[]",
        "'Store::load', 1, 'entrypoint_flow', true, 207, ['return', 'self.run']",
        "'Store::run', 1, 'entrypoint_flow', true, 211, ['try', 'eval', 'return', 'print']",
        "'api::create', 1, 'entrypoint_flow', true, 154, ['not body', 'throw', 'ValueError', 'save_order', 'return']",
        "'api::read', 1, 'entrypoint_flow', true, 209, ['Store', 'return', 'store.load']",
        "'api::save_order', 1, 'entrypoint_flow', true, 149, ['return', 'Store', '[dynamic].save']",
        "'client::loadOrder', 1, 'entrypoint_flow', true, 107, ['get', 'return']",
        "'http::get', 1, 'entrypoint_flow', true, 107, ['return', 'fetch']",
    ),
    "capability_cards": rows(
        "key VARCHAR, contracts VARCHAR[], frameworks VARCHAR[], packages VARCHAR[], names VARCHAR[], units BIGINT, resources VARCHAR[], called VARCHAR[]",
        "'health', ['GET:/health'], [], ['web::client'], ['client::loadOrder'], 1, NULL, ['get']",
        "'orders', ['GET:/orders/:param', 'POST:/orders'], ['python.fastapi'], ['src::orders::api'], ['api::create', 'api::read'], 2, ['orders'], ['Store', 'load', 'save_order']",
    ),
    "required_ids": rows(
        "bucket VARCHAR, kind VARCHAR, n BIGINT",
        "'orders', 'entrypoint', 2",
        "'orders', 'resource', 1",
        "'web', 'entrypoint', 2",
    ),
    "dynamic_boundaries": rows(
        "owner VARCHAR, name VARCHAR, line INTEGER",
        "'src::orders::api::save_order', '[dynamic].save', 21",
        "'src::orders::store::Store::run', 'eval', 15",
    ),
    "analysis_integrity": rows(
        "reference VARCHAR, missing BIGINT",
        "'entrypoints', 0",
        "'entrypoints.unit_id', 0",
        "'files', 0",
        "'flow_edges.source_id', 0",
        "'flow_edges.target_id', 0",
        "'flow_links.target_unit_id', 0",
        "'flows', 0",
        "'references', 0",
        "'references.source_id', 0",
        "'references.target_id', 0",
        "'units', 0",
    ),
    "fact_limits": rows(
        "name VARCHAR, n BIGINT",
        "'flows', 0",
        "'units', 4",
        "'units: 4', 1",
    ),
    "clean_bundle": rows(
        "name VARCHAR, n BIGINT",
        "'coverage', 3",
        "'domains', 2",
        "'entrypoints', 5",
        "'features', 3",
        "'flows', 11",
        "'from domains', 2",
        "'from entrypoints', 5",
        "'from features', 3",
        "'from files', 6",
        "'from flows', 11",
        "'from relations', 0",
        "'from resources', 2",
        "'from units', 18",
        "'relations', 0",
        "'resources', 2",
        "'units', 18",
    ),
    "saved_map": rows(
        "bucket VARCHAR, status VARCHAR, score INTEGER, files INTEGER, features BIGINT, reachable BIGINT, labels VARCHAR[]",
        "'orders', 'candidate', 55, 2, 2, 7, ['Orders']",
        "'web', 'candidate', 35, 2, 1, 2, ['Health']",
    ),
    "snapshots": rows(
        "what VARCHAR, a VARCHAR, b VARCHAR",
        "'contract', 'GET:/health', 'web'",
        "'contract', 'GET:/orders/:param', 'orders'",
        "'contract', 'POST:/orders', 'orders'",
        "'domain', 'health', 'web'",
        "'domain', 'orders', 'orders'",
        "'kind', 'GET:/health', 'return'",
        "'kind', 'GET:/health', 'sequential'",
        "'kind', 'GET:/orders/:param', 'return'",
        "'kind', 'GET:/orders/:param', 'sequential'",
        "'kind', 'POST:/orders', 'exception'",
        "'kind', 'POST:/orders', 'falseBranch'",
        "'kind', 'POST:/orders', 'return'",
        "'kind', 'POST:/orders', 'sequential'",
        "'kind', 'POST:/orders', 'trueBranch'",
    ),
    "overview_sections": rows(
        "section VARCHAR, n BIGINT",
        "'diagnostics', 1",
        "'domains', 2",
        "'dynamicBoundaries', 2",
        "'edges', 21",
        "'features', 3",
        "'flows', 11",
        "'frameworks', 1",
        "'links', 8",
        "'relations', 0",
        "'summary', 4",
    ),
    "formed_domains": rows(
        "key VARCHAR, label VARCHAR, members BIGINT, status VARCHAR, kind VARCHAR, reason VARCHAR",
        "'health', 'Health', 1, 'candidate', 'crossCutting', NULL",
        "'orders', 'Orders', 1, 'candidate', 'business', NULL",
    ),
    "framework_detection": rows(
        "project VARCHAR, framework VARCHAR, file_id VARCHAR, line INTEGER, confidence DOUBLE",
        "'ecma', 'javascript.fastify', 'e1', 1, 0.7",
        "'ecma', 'javascript.koa', 'e1', 2, 0.7",
        "'ecma', 'javascript.nuxt', 'e2', 1, 0.7",
        "'ecma', 'javascript.sveltekit', 'e3', 1, 0.7",
        "'go', 'go.beego', 'g1', 9, 0.7",
        "'go', 'go.chi', 'g1', 8, 0.7",
        "'go', 'go.echo', 'g1', 6, 0.7",
        "'go', 'go.fiber', 'g1', 7, 0.7",
        "'go', 'go.gin', 'g1', 5, 0.7",
        "'go', 'go.net_http', 'g1', 4, 0.7",
        "'native', 'c.qt', 'n1', 1, 0.7",
        "'native', 'cpp.mfc', 'n2', 1, 0.7",
        "'native', 'cpp.unreal_engine', 'n2', 2, 0.7",
        "'native', 'csharp.aspnet_core', 'n3', 1, 0.7",
        "'native', 'csharp.blazor', 'n3', 9, 0.7",
        "'native', 'csharp.dotnet_maui', 'n3', 3, 0.7",
        "'native', 'csharp.minimal_api', 'n3', 6, 0.7",
        "'polyglot', 'dart.shelf', 'p4', 1, 0.7",
        "'polyglot', 'java.micronaut', 'p2', 1, 0.7",
        "'polyglot', 'java.quarkus', 'p1', 1, 0.7",
        "'polyglot', 'python.sanic', 'p3', 1, 0.7",
        "'polyglot', 'rust.axum', 'p5', 1, 0.7",
        "'routers', 'cpp.drogon', 'r5', 1, 0.7",
        "'routers', 'csharp.aspnet_mvc', 'r6', 1, 0.7",
        "'routers', 'python.fastapi', 'r1', 1, 0.85",
        "'routers', 'python.fastapi', 'r2', 1, 0.85",
        "'routers', 'python.fastapi', 'r3', 1, 0.85",
        "'routers', 'python.fastapi', 'r4', 1, 0.85",
    ),
    "matrix_native": rows(
        "framework VARCHAR, kind VARCHAR, method VARCHAR, path VARCHAR, unit VARCHAR, line INTEGER",
        "'cpp.mfc', 'component', NULL, NULL, 'native::MainWindow', NULL",
        "'cpp.unreal_engine', 'component', NULL, NULL, 'native::Monster', NULL",
        "'csharp.blazor', 'component', NULL, NULL, 'program::Panel', NULL",
        "'csharp.dotnet_maui', 'component', NULL, NULL, 'program::Start', NULL",
        "'csharp.minimal_api', 'http', 'GET', '/status-page', 'program::Program::Show', 6",
    ),
    "matrix_go": rows(
        "framework VARCHAR, kind VARCHAR, method VARCHAR, path VARCHAR, unit VARCHAR, line INTEGER",
        "'go.beego', 'http', 'GET', '/from-beego', 'routes::serve', 22",
        "'go.chi', 'http', 'GET', '/from-chi', 'routes::serve', 21",
        "'go.echo', 'http', 'GET', '/from-echo', 'routes::serve', 17",
        "'go.fiber', 'http', 'GET', '/from-fiber', 'routes::serve', 19",
        "'go.gin', 'http', 'GET', '/from-gin', 'routes::serve', 15",
        "'go.net_http', 'http', 'HTTP', '/from-http', 'routes::serve', 23",
    ),
    "matrix_ecma": rows(
        "framework VARCHAR, kind VARCHAR, method VARCHAR, path VARCHAR, unit VARCHAR, line INTEGER",
        "'javascript.fastify', 'http', 'GET', '/from-fastify', 'router::serve', 7",
        "'javascript.koa', 'http', 'GET', '/from-koa', 'router::serve', 10",
        "'javascript.nuxt', 'http', 'HTTP', '/users', 'server::api::users', 1",
        "'javascript.sveltekit', 'http', 'HTTP', '/items', 'routes::items::+server', 1",
    ),
    "matrix_polyglot": rows(
        "framework VARCHAR, kind VARCHAR, method VARCHAR, path VARCHAR, unit VARCHAR, line INTEGER",
        "'dart.shelf', 'http', 'GET', '/from-shelf', 'shelf::serve', 3",
        "'java.micronaut', 'http', 'GET', '/cart/lines', 'Cart::Cart::lines', 5",
        "'java.quarkus', 'http', 'GET', '/stock/parts', 'Stock::Stock::parts', 4",
        "'python.sanic', 'http', 'GET', '/from-sanic', 'site::front', 3",
        "'rust.axum', 'http', 'GET', '/from-axum', 'axum::serve', 3",
    ),
    "matrix_routers": rows(
        "framework VARCHAR, kind VARCHAR, method VARCHAR, path VARCHAR, unit VARCHAR, line INTEGER",
        "'cpp.drogon', 'http', 'GET', '/todos', 'todo::Todos::list', 6",
        "'cpp.drogon', 'http', 'POST', '/todos', 'todo::Todos::list', 6",
        "'csharp.aspnet_mvc', 'http', 'GET', '/own', 'Pages::ReportController::Own', 5",
        "'csharp.aspnet_mvc', 'http', 'HTTP', '/Admin/Report/Index', 'Pages::ReportController::Index', 4",
        "'python.fastapi', 'http', 'GET', '/v1/users/{id}', 'shop::users::read', 8",
        "'python.fastapi', 'http', 'GET', NULL, 'shop::carts::open_carts', 6",
        "'python.fastapi', 'http', 'POST', '/v1/users/admin/roles', 'shop::roles::add', 6",
    ),
    "call_events": rows(
        "path VARCHAR, unit VARCHAR, line INTEGER",
        "'order.created', 'web::client::loadOrder', 6",
    ),
    "manifest_frameworks": rows(
        "framework VARCHAR, path VARCHAR, line INTEGER",
        "'javascript.express', 'package.json', 2",
        "'javascript.nestjs', 'package.json', 3",
        "'python.django', 'pyproject.toml', 2",
        "'python.flask', 'requirements.txt', 1",
    ),
    "bucket_cap_rows": rows(
        "bucket VARCHAR, goes VARCHAR",
        "'a', 'a'",
        "'a/x', 'a'",
        "'a/y', 'a'",
        "'b', 'b'",
        "'b/z', 'b'",
        "'c', 'c'",
        "'d', 'd'",
    ),
    "cluster_rows": rows(
        "item VARCHAR, cluster VARCHAR",
        "'a', 'a'",
        "'b', 'a'",
        "'c', 'a'",
        "'d', 'd'",
        "'e', 'd'",
    ),
    "chunk_rows": rows(
        "chunk INTEGER, ord INTEGER, domain VARCHAR",
        "0, 0, 'a'",
        "0, 1, 'c'",
        "1, 0, 'b'",
        "1, 1, 'e'",
        "2, 0, 'd'",
    ),
    "context_fits": rows(
        "what VARCHAR, n INTEGER, id VARCHAR",
        "'feature', 0, 'f1'",
        "'flow', 1, 'w1'",
        "'flow', 1, 'w2'",
        "'part', 0, 'a'",
        "'part', 0, 'b'",
        "'part', 1, 'c'",
        "'part', 2, 'd'",
    ),
    "catalog_reports": rows(
        "ord VARCHAR, line VARCHAR",
        "'1a', 'PASSED a 0 findings'",
        "'1b', 'FAILED b 2 findings'",
        "'1c', 'UNAVAILABLE c 0 findings'",
        "'2', '1 passed, 2 failed'",
    ),
    "diagnosis_runs": rows(
        "project VARCHAR, mode VARCHAR, skipped VARCHAR",
        "'a', 'legacyStrictKey', NULL",
        "'a', 'structuralCrossKey', NULL",
        "'b', 'legacyStrictKey', 'no path'",
        "'b', 'structuralCrossKey', 'no path'",
        "'c', 'legacyStrictKey', 'missing directory'",
        "'c', 'structuralCrossKey', 'missing directory'",
    ),
    "gold_matches": rows(
        "what VARCHAR, a VARCHAR, b VARCHAR",
        "'contract', '*:/health', 'GET:/health'",
        "'contract', 'GET:/orders/:param', 'GET:/orders/:param'",
        "'domain', 'orders', 'd1'",
        "'domain', 'payment', 'd2'",
        "'forbidden', 'X', ''",
        "'forbidden', 'api', ''",
        "'forbidden', 'src', ''",
    ),
    "absorbed_domains": rows(
        "what VARCHAR, a VARCHAR, b VARCHAR",
        "'absorb', 'canonical-key', '1'",
        "'absorbed', 'd2', 'd1'",
        "'merge', 'http+call', '2'",
        "'merge', 'structural', '1'",
    ),
    "feature_marks": rows(
        "id INTEGER, tags VARCHAR[], priority INTEGER, hints VARCHAR[], key VARCHAR, threshold BIGINT",
        "1, ['endpoint'], 107, ['http', 'a', 'b'], 'orders', 525",
        "2, ['resourceAccess', 'sideEffect'], 160, ['rpc', 'a', 'b'], 'billing', 22500",
        "3, ['dynamicBoundary'], 40, ['job', 'a', 'b'], 'nightly', 200",
        "4, ['internal'], 45, ['http', 'a', 'b'], 'user', 375",
    ),
    "aggregate_statuses": rows(
        "kind VARCHAR, confirmed BIGINT, candidate BIGINT, unknown BIGINT, dynamic BIGINT",
        "'call', 10, 0, 6, 2",
        "'import', 2, 0, 1, 0",
    ),
}
