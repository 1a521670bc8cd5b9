"""The SQL of a small repository in many languages, with its text put together from keys."""

REPO = """
SELECT concat('docs/', CASE c_custkey % 3 WHEN 0 THEN 'user-stories/US-' WHEN 1 THEN 'decisions/ADR-' ELSE 'notes/n-' END, lpad(concat(c_custkey % 997, ''), 3, '0'), CASE WHEN c_custkey >= 997 THEN concat('-', c_custkey) ELSE '' END, CASE WHEN c_custkey % 11 = 0 THEN '.markdown' ELSE '.md' END) AS path,
concat('---', chr(10), CASE WHEN c_custkey % 5 = 0 THEN concat('id: IDR-', lpad(concat(c_custkey % 997, ''), 3, '0'), chr(10)) ELSE '' END, CASE WHEN c_custkey % 4 = 0 THEN concat('title: ', c_name, chr(10)) ELSE '' END,
'supersedes: ADR-', lpad(concat((c_custkey + 3) % 997, ''), 3, '0'), ', US-', lpad(concat((c_custkey + 5) % 997, ''), 3, '0'), chr(10), '---', chr(10), '# ', c_mktsegment, ' ', c_nationkey, chr(10), '## Plan ', c_custkey % 7, chr(10), '### Deep', chr(10),
'- must hold ', c_custkey % 50, chr(10), '* may wait', chr(10), '  + Will, surely ', c_nationkey, chr(10), 'see [x](../decisions/ADR-', lpad(concat((c_custkey * 7) % 997, ''), 3, '0'), '.md#a) and [y](/web/f', c_custkey % 40, '.ts) and [z](https://a.b/c) and [w](gone', c_custkey % 13, '.md)', chr(10), '```sh', chr(10), 'make r', c_nationkey, '  ', chr(10), '```', chr(10), 'the end', chr(10)) AS body
FROM {customer}
UNION ALL SELECT concat(CASE WHEN p_partkey % 6 = 0 THEN 'web/sub/f' ELSE 'web/f' END, p_partkey, CASE p_partkey % 8 WHEN 1 THEN '.test.ts' WHEN 2 THEN '.tsx' WHEN 3 THEN '.spec.ts' ELSE '.ts' END),
concat('import a from ''./f', p_partkey + 1, ''';', chr(10), 'import b from "../web/f', p_partkey - 1, '.js";', chr(10), 'import ''lib', p_size, ''';', chr(10), '/* implements US-999 */', chr(10), '// implements US-', lpad(concat((p_partkey * 3) % 997, ''), 3, '0'), chr(10),
'export async function run', p_partkey, '() ', chr(10), 'export const K', p_size, ' = "ADR-001"; // export const no = 1', chr(10), 'export default abstract class C', p_partkey % 9, ' ', chr(10), 'app.get(''/items/', p_size, ''', h)', chr(10), 'use("rate_', p_partkey % 30, '"); read("data/f', p_partkey % 20, '.json", ''./f', p_partkey - 6, '.ts'')', chr(10), 'x = US-', lpad(concat(p_partkey % 997, ''), 3, '0'), ' + ADR-', lpad(concat((p_partkey * 5) % 997, ''), 3, '0'), chr(10))
FROM {part}
UNION ALL SELECT concat('svc/m', s_suppkey % 7, '/s', s_suppkey, '.py'),
concat('from .s', s_suppkey + 7, ' import x', chr(10), 'from ..m', s_suppkey % 5, ' import y', chr(10), 'from . import z', chr(10), '@app.route("/p/', s_suppkey, '", methods=["GET", ''post''])', chr(10), 'def page_', s_suppkey, '(a):', chr(10), '    pass  # implements US-', lpad(concat(s_suppkey % 997, ''), 3, '0'), chr(10), '@r.get("/q/', s_suppkey % 10, '")', chr(10), 'class V', s_suppkey, '(B):', chr(10), 'LIMIT_', s_suppkey % 4, ' = 3', chr(10))
FROM {supplier}
UNION ALL SELECT concat('svc/m', s_suppkey % 7, '/test_s', s_suppkey, '.py'), 'import x' FROM {supplier} WHERE s_suppkey % 3 = 0
UNION ALL SELECT DISTINCT concat('svc/m', s_suppkey % 7, '/__init__.py'), '' FROM {supplier} WHERE s_suppkey % 7 < 4
UNION ALL SELECT concat('sql/n', n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '.sql' WHEN 1 THEN '.proto' ELSE '.graphql' END),
concat('create table if not exists s.', n_name, ' (a int);', chr(10), ' CREATE OR REPLACE VIEW "v_', n_nationkey, '" AS SELECT 1;', chr(10), 'message M', n_nationkey, ' ', chr(10), 'type T', n_nationkey % 5, ' ', chr(10)) FROM {nation}
UNION ALL SELECT concat('metrics/rate_', s_suppkey, '.yaml'), concat('name: rate_', s_suppkey) FROM {supplier}
UNION ALL SELECT concat('docs/evidence/', CASE WHEN s_suppkey % 2 = 0 THEN concat('US-', lpad(concat(s_suppkey % 997, ''), 3, '0'), CASE WHEN s_suppkey >= 997 THEN concat('-', s_suppkey) ELSE '' END) ELSE concat('Run ', s_suppkey) END, '/log.txt'), concat('"data/f', s_suppkey, '.json"') FROM {supplier}
UNION ALL SELECT concat('make/r', r_regionkey, '/Makefile'), concat('V := 1', chr(10), 'build-', r_regionkey, ': dep', chr(10), chr(9), 'echo x', chr(10), '# no: x', chr(10), '.PHONY: a', chr(10), 'test::', chr(10), 'a%b: c', chr(10), '  lint: x # y', chr(10)) FROM {region}
UNION ALL SELECT concat('bin/run', r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN '.sh' ELSE '' END), CASE r_regionkey % 3 WHEN 0 THEN concat('#!/usr/bin/env bash', chr(10), 'x') WHEN 1 THEN concat('#!/bin/sh', chr(10)) ELSE 'plain' END FROM {region}
UNION ALL SELECT concat('data/f', n_nationkey, '.json'), concat('["rate_', n_nationkey, '"]') FROM {nation}
"""

#: The SQL of a Go module: a package for each fiftieth part, a file for each part.
GO_REPO = """
SELECT 'go.mod' AS path, concat('module ex.org/m', chr(10)) AS body FROM {region} WHERE r_regionkey = 0
UNION ALL SELECT concat('pkg', p_partkey % 50, '/f', p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '_test.go' ELSE '.go' END),
concat('package pkg', p_partkey % 50, chr(10), chr(10), 'import (', chr(10), chr(9), '"fmt"', chr(10), chr(9), '"ex.org/m/pkg', (p_partkey + 1) % 50, '"', chr(10), chr(9), 'q "ex.org/m/none', p_partkey % 3, '"', chr(10), ')', chr(10), chr(10),
'// Run goes on: implements US-', lpad(concat(p_partkey % 997, ''), 3, '0'), chr(10), 'func Run', p_partkey, '(a int) int {', chr(10), chr(9), 'fmt.Println("helper(", q.Name)', chr(10), chr(9), 'helper', p_partkey, '()', chr(10), chr(9), 'pkg', (p_partkey + 1) % 50, '.Run', p_partkey + 1, '(a)', chr(10),
chr(9), 'mux.Get("/items/', p_size, '", handle)', chr(10), chr(9), 'return a', chr(10), '}', chr(10), chr(10), 'func helper', p_partkey, '() {}', chr(10), chr(10), 'func (s *T', p_partkey, ') Do', p_partkey, '() { helper', p_partkey, '() }', chr(10), chr(10),
'/* T', p_partkey, ' holds */', chr(10), 'type T', p_partkey, ' struct { A int }', chr(10), chr(10), 'const K', p_partkey, ' = 1', chr(10), chr(10), 'var v', p_partkey, ' = 2', chr(10))
FROM {part}
"""
