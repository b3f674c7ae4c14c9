"""Nested, commented and quoted code of each language against entities written down by hand."""

import pytest
from pyspark.sql import functions as F

from lorespark.operators.code_scan import code_entities, scan

CODE = {
    "javascript": (
        """import React, { useState } from 'react';
import './style.css'
// class Hidden { }
/* function gone() { } */
const text = "function no() {";
const pattern = /class Bad \\{ "/g;
export default class Shop extends Base {
  #count = 0;
  constructor(a) { super(a); if (a) { this.x = `t ${a ? `class Q { ${a}` : '}'} {`; } }
  async load(url) {
    function inner(x) { return x / 2 / 1; }
    for (const i of [1, 2]) { switch (i) { case 1: break } }
    return fetch(url).then((r) => { return r.json() })
  }
  get total() { return 1 }
  handler = (e) => {
    e.stop();
  };
}
const add = (a, b) => a + b
export const make = async function (n) { return n };
function* walk() {}
items.forEach(function (x) { class Local { go() {} } })
""",
        [("react", "import", None, 1, 1), ("./style.css", "import", None, 2, 2), ("Shop", "class", None, 7, 19), ("constructor", "constructor", "Shop", 9, 9), ("load", "method", "Shop", 10, 14), ("inner", "function", "load", 11, 11),
         ("total", "method", "Shop", 15, 15), ("handler", "arrow_function", "Shop", 16, 18), ("add", "arrow_function", None, 20, 20), ("make", "function", None, 21, 21), ("walk", "function", None, 22, 22), ("Local", "class", None, 23, 23), ("go", "method", "Local", 23, 23)],
    ),
    "typescript": (
        """import { A } from "./a";
export interface Shape<T> extends Base {
  area(): number;
}
type Pair = { a: string; b: number };
enum Color { Red, Green = "}" }
namespace Tools {
  export function run<T>(x: T): T { return x; }
}
abstract class Box<T> implements Shape<T> {
  @Input() size: number = 3;
  constructor(private readonly a: string) {}
  public static of<T>(x: T): Box<T> { return new Box(x); }
  area(): number { return 2; }
}
export const f = (x: number): number => { return x; };
""",
        [("./a", "import", None, 1, 1), ("Shape", "interface", None, 2, 4), ("Pair", "type", None, 5, 5), ("Color", "enum", None, 6, 6), ("Tools", "namespace", None, 7, 9), ("run", "function", "Tools", 8, 8), ("Box", "class", None, 10, 15),
         ("constructor", "constructor", "Box", 12, 12), ("of", "method", "Box", 13, 13), ("area", "method", "Box", 14, 14), ("f", "arrow_function", None, 16, 16)],
    ),
    "java": (
        """package com.shop.core;
import java.util.List;
import static java.lang.Math.*;
/** class Fake { void x() {} } */
@Entity(name = "t")
public class Order<T extends Comparable<T>> extends Base implements Runnable {
    private static final String S = "} class Z {";
    private char c = '{';
    public Order(int a) throws IOException { this.a = a; }
    @Override
    public void run() {
        Runnable r = new Runnable() { public void run() { } };
        for (int i = 0; i < 3; i++) { if (i > 1) { go(i); } else { stop(); } }
        list.forEach(x -> { print(x); });
    }
    static <K> Map<K, List<T>> group(K k, T... t) { return null; }
    interface Visitor { void visit(Order o); default int n() { return 1; } }
    enum State { OPEN, CLOSED; boolean open() { return this == OPEN; } }
    record Point(int x, int y) { }
    abstract static class Inner { abstract int size(); }
}
""",
        [("com.shop.core", "package", None, 1, 1), ("java.util.List", "import", None, 2, 2), ("java.lang.Math.*", "import", None, 3, 3), ("Order", "class", None, 5, 21), ("Order", "constructor", "Order", 9, 9), ("run", "method", "Order", 10, 15), ("run", "method", "run", 12, 12),
         ("group", "method", "Order", 16, 16), ("Visitor", "interface", "Order", 17, 17), ("visit", "method", "Visitor", 17, 17), ("n", "method", "Visitor", 17, 17), ("State", "enum", "Order", 18, 18), ("open", "method", "State", 18, 18),
         ("Point", "class", "Order", 19, 19), ("Inner", "class", "Order", 20, 20), ("size", "method", "Inner", 20, 20)],
    ),
    "csharp": (
        """using System;
using Json = System.Text.Json;
namespace Shop.Core
{
    [Serializable]
    public sealed class Cart : Base, IThing
    {
        private string path = @"C:\\dir\\{";
        public int Count { get; set; } = 3;
        public string Name => "x";
        public Cart(int n) : base(n) { }
        public override async Task<List<int>> LoadAsync<T>(string s = "}") where T : class
        {
            using (var f = Open()) { if (f != null) { foreach (var x in f) { Use(x); } } }
            using var g = Open();
            return $"{s} class No {{";
        }
        public int Twice(int x) => x * 2;
    }
    interface IThing { void Go(int a); }
    struct P { public int X; }
    enum E { A, B }
}
""",
        [("System", "import", None, 1, 1), ("System.Text.Json", "import", None, 2, 2), ("Shop.Core", "namespace", None, 3, 23), ("Cart", "class", "Shop.Core", 5, 19), ("Count", "property", "Cart", 9, 9), ("Name", "property", "Cart", 10, 10), ("Cart", "constructor", "Cart", 11, 11),
         ("LoadAsync", "method", "Cart", 12, 17), ("Twice", "method", "Cart", 18, 18), ("IThing", "interface", "Shop.Core", 20, 20), ("Go", "method", "IThing", 20, 20), ("P", "struct", "Shop.Core", 21, 21), ("E", "enum", "Shop.Core", 22, 22)],
    ),
    "go": (
        """package main

import (
	"fmt"
	log "github.com/x/log"
)
import "os"

const Limit = 3
var (
	a = 1
	b, c int
)
// func no() {}
type Point struct {
	X, Y int
}
type (
	Shape interface {
		Area() float64
	}
	ID int
)
func (p *Point) Move(dx int) (int, error) {
	s := `func fake() {`
	go func() { fmt.Println('}') }()
	if x := f(); x > 1 { return 1, nil }
	return 0, nil
}
func Map[T any](xs []T, f func(T) T) []T { return nil }
""",
        [("main", "package", None, 1, 1), ("fmt", "import", None, 4, 4), ("github.com/x/log", "import", None, 5, 5), ("os", "import", None, 7, 7), ("Limit", "const", None, 9, 9), ("a", "variable", None, 11, 11), ("b", "variable", None, 12, 12), ("Point", "struct", None, 15, 17),
         ("Shape", "interface", None, 19, 21), ("ID", "type", None, 22, 22), ("Move", "method", "Point", 24, 29), ("Map", "function", None, 30, 30)],
    ),
    "rust": (
        """use std::collections::HashMap;
use crate::{a, b::C};
mod helper;
/* outer /* fn nested() {} */ still */
pub const MAX: usize = 3;
#[derive(Debug)]
pub struct Point<T> { x: T }
struct Unit;
enum Kind { A(i32), B { n: u8 } }
pub trait Shape { fn area(&self) -> f64; fn twice(&self) -> f64 { self.area() * 2.0 } }
impl<T: Clone> Shape for Point<T> where T: Copy {
    fn area(&self) -> f64 { let s = r#"fn no() { " }"#; match s { "a" => { 1.0 } _ => 2.0 } }
}
impl Point<i32> { pub async fn new(x: i32) -> Self { Self { x } } }
mod inner { pub(crate) unsafe fn f<'a>(x: &'a str) -> Vec<&'a str> { vec![x] } }
fn main() { let c = '{'; let f = |x: i32| { x + 1 }; }
""",
        [("std::collections::HashMap", "import", None, 1, 1), ("crate::", "import", None, 2, 2), ("helper", "module", None, 3, 3), ("MAX", "const", None, 5, 5), ("Point", "struct", None, 6, 7), ("Unit", "struct", None, 8, 8), ("Kind", "enum", None, 9, 9), ("Shape", "trait", None, 10, 10),
         ("twice", "method", "Shape", 10, 10), ("Point", "impl", None, 11, 13), ("area", "method", "Point", 12, 12), ("Point", "impl", None, 14, 14), ("new", "method", "Point", 14, 14), ("inner", "module", None, 15, 15), ("f", "function", "inner", 15, 15), ("main", "function", None, 16, 16)],
    ),
    "c": (
        """#include <stdio.h>
#define SQ(x) \\
  ((x) * (x))
/* int fake(void) { } */
typedef struct { int x; char *s; } Pair;
typedef unsigned long u64;
struct node { struct node *next; };
static const char *names[] = { "a {", "b" };
int prototype(int a);
static struct node *make(int a, char b[3])
{
    if (a) { while (a--) { call(a); } }
    char c = '{';
    return 0;
}
union U { int a; };
enum color { RED };
int main(void) { return 0; }
""",
        [("stdio.h", "include", None, 1, 1), ("SQ", "define", None, 2, 3), ("Pair", "type", None, 5, 5), ("u64", "type", None, 6, 6), ("node", "struct", None, 7, 7), ("make", "function", None, 10, 15), ("U", "union", None, 16, 16), ("color", "enum", None, 17, 17), ("main", "function", None, 18, 18)],
    ),
    "cpp": (
        """#include "shop.h"
namespace shop::core {
template <typename T>
class Cart : public Base<T> {
 public:
  explicit Cart(int n) : n_(n), v_{1, 2} { }
  ~Cart() { }
  int size() const noexcept override { return n_; }
  Cart& operator+=(const Cart& o) { return *this; }
  void declared(int x);
  struct Item { int id; };
 private:
  int n_ = 0;
};
}
enum class Kind : int { A, B };
void Cart::declared(int x) {
  auto f = [x](int y) { return x + y; };
  const char* s = R"(void fake() { )";
  for (auto& i : list) { use(i); }
}
template <class T> T twice(T x) { return x + x; }
""",
        [("shop.h", "include", None, 1, 1), ("shop::core", "namespace", None, 2, 15), ("Cart", "class", "shop::core", 3, 14), ("Cart", "constructor", "Cart", 5, 6), ("~Cart", "method", "Cart", 7, 7), ("size", "method", "Cart", 8, 8), ("operator+=", "method", "Cart", 9, 9),
         ("Item", "struct", "Cart", 11, 11), ("Kind", "enum", None, 16, 16), ("declared", "method", "Cart", 17, 21), ("twice", "function", None, 22, 22)],
    ),
    "html": (
        """<!DOCTYPE html>
<html><body>
<!-- a <div> -->
<div
  id="x"><p>text <br> more
</p></div>
<script>var s = "<p>";</script><style>p {}</style>
</body></html>""",
        [("html", "doctype", None, 1, 1), ("html", "element", None, 2, 8), ("body", "element", "html", 2, 8), ("a <div>", "comment", "body", 3, 3), ("div", "element", "body", 4, 6), ("p", "element", "div", 5, 6), ("br", "element", "p", 5, 5), ("script", "script_element", "body", 7, 7), ("style", "style_element", "body", 7, 7)],
    ),
    "css": (
        """@import url("base.css");
/* .no { } */
a:hover, .b > c::before { content: "} {"; }
@media (max-width: 600px) {
  .d { color: red; }
}
@keyframes spin { from { top: 0 } to { top: 1px } }
@font-face { font-family: x }
""",
        [("base.css", "import", None, 1, 1), ("a:hover, .b > c::before", "rule_set", None, 3, 3), ("media", "media_query", None, 4, 6), (".d", "rule_set", "media", 5, 5), ("spin", "keyframes", None, 7, 7), ("from", "rule_set", "spin", 7, 7), ("to", "rule_set", "spin", 7, 7), ("font-face", "at_rule", None, 8, 8)],
    ),
}


@pytest.mark.parametrize("language", CODE)
def test_entities(language):
    text, want = CODE[language]
    assert [tuple(r) for r in scan(text, language)] == want


@pytest.mark.parametrize("language", CODE)
def test_broken_code_is_read_as_far_as_it_goes(language):
    text, want = CODE[language]
    for cut in range(0, len(text), 7):
        scan(text[:cut], language)
        scan(text[cut:], language)
    names = [r[0] for r in scan(text[: len(text) * 3 // 4], language)]
    assert names[:3] == [w[0] for w in want][:3]


def test_files(spark):
    rows = [("a.py", "python", "class A:\n    def f(self):\n        pass\n"), ("b.go", "go", "package b\nfunc F() {}\n"), ("c", "cobol", "x"), ("d", None, "y"), ("e.c", "c", None), ("f.c", "c", "int f() { }\0"), ("g.c", "c", "x" * (1 << 20) + "yz"), ("h.java", "java", "")]
    got = sorted(tuple(r) for r in code_entities(spark.createDataFrame(rows, "path string, language string, content string")).select("path", "language", "name", "entity_type", "line_start", "line_end").collect())
    assert got == [("a.py", "python", "A", "class", 1, 3), ("a.py", "python", "f", "method", 2, 3), ("b.go", "go", "F", "function", 2, 2), ("b.go", "go", "b", "package", 1, 1)]


def test_files_are_dealt_to_all_tasks(spark):
    files = spark.range(40).select(F.col("id").cast("string").alias("path"), F.lit("java").alias("language"), F.lit("class A {\n}").alias("content")).coalesce(1)
    out = code_entities(files)
    assert out.count() == 40 and out.select(F.spark_partition_id()).distinct().count() > 1


def test_long_files_are_read_whole_in_time_that_grows_with_them(spark):
    """Each takes minutes or more where every line, tag or element looks at all others."""
    n = 30_000
    made = {
        "java": ("class A {\n", "  void m%d() { int a = 1; go(a); return; }\n", "}\n", n + 1),
        "javascript": ("const data = [\n", '  {a: %d, b: [1, 2], c: {d: "x"}},\n', "];\nfunction last() {\n}\n", 1),
        "go": ("package a\n", "func f%d(a int) {\n\n\treturn\n}\n", "", n + 1),
        "html": ("<ul>\n", "<li>some words of a long list %d\n<b></b>", "</ul>\n", 2 * n + 1),
        "css": ("", ".m%d { color: red; background: blue }\n", "", n),
    }
    texts = {k: first + "".join(line % i for i in range(n)) + last for k, (first, line, last, _) in made.items()}
    assert max(map(len, texts.values())) > 1 << 20
    files = spark.createDataFrame([(k, k, t) for k, t in {**texts, "c": "int f() {}\n" + "// long\n" * (1 << 18)}.items()], "path string, language string, content string")
    got = {r.path: r["count"] for r in code_entities(files).groupBy("path").count().collect()}
    assert got == {"c": 1, **{k: v[3] for k, v in made.items()}}
