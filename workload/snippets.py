"""Source fragments that the corpus is put together from.

@K@ stands for a key of the row and @P@ for a text column, so contents differ from row to row. Every
rule has a fragment that fires it and one that just misses it.
"""

PYTHON = [
    "import zlib; import gzip as gz\nif @K@: import bz2\nx = 1; from lzma import open as lopen  # late",
    "import os\nimport sys, json\nfrom collections import OrderedDict",
    "from helpers import *\nimport module_@K@  # loaded late\nfrom pkg.sub import (\n    first,\n    second,\n)",
    "def run_@K@(cmd):\n    os.system(cmd + '@K@')\n    return os.system('ls')",
    "subprocess.call(cmd, shell=True)\nsubprocess.call('ls')\nsubprocess.Popen(args)\nresult = eval(expr)",
    'cursor.execute("SELECT * FROM t WHERE id = " + str(@K@))\nrows = cursor.fetchall()',
    'db.execute("SELECT %s" % name)\ndb.execute(f"SELECT {name} FROM t")\ndb.execute("SELECT 1", args)',
    "data = pickle.loads(blob)\nobj = pickle.load(handle)\ncfg = yaml.load(stream)\n"
    "code = marshal.loads(raw)\nsafe = yaml.load(stream, Loader)",
    "password = 'hunter@K@'\nAPI_KEY = \"k-@K@\"\nsecret = 'os.environ lookup'\nToken = \"@P@\"\nclient_secret = 's-@K@'",
    "try:\n    load()\nexcept:\n    pass\nexcept ValueError:\n    raise\nfinally:\n    close()",
    "def collect(items=[], seen={}):\n    for item in items:\n        if item not in seen and item is not None:\n"
    "            seen[item] = @K@\n    return seen",
    "def gather(size, rest=( ), extra=None):\n    return [x for x in rest if x > size or x < 2.5]",
    "class Registry@K@:\n    _instance = None\n\n    def __new__(cls, *args):\n        if cls._instance is None:\n"
    "            cls._instance = super().__new__(cls)\n        return cls._instance\n\n    @classmethod\n"
    "    def instance(cls):\n        if not hasattr(cls, '_instance'):\n            cls._instance = cls()\n"
    "        return cls._instance\n\n    @classmethod\n    def get_instance(cls):\n        return cls._instance",
    "class WidgetFactory:\n    @classmethod\n    def create(cls, kind):\n        return kind()\n\n    @classmethod\n"
    "    def from_config(cls, cfg):\n        return cls(cfg)\n\n    def create_widget(self, size):\n        return size * @K@",
    "class Subject:\n    def __init__(self):\n        self._observers = []\n\n    def add_observer(self, o):\n"
    "        self._observers.append(o)\n\n    def remove_observer(self, o):\n        self._observers.remove(o)\n\n"
    "    def notify_observers(self):\n        for observer in self._observers:\n            observer.notify(@K@)",
    "class Bus(Base):\n    def register(self, handler):\n        pass\n\n    def unregister(self, handler):\n        pass\n\n"
    "    def notify(self):\n        for observer in self.observers:\n            observer()",
    "@functools.wraps(fn)\ndef wrapper(*args):\n    return fn(*args)\n\n@dataclass\nclass Point(Base):\n    x: int = @K@",
    "class Wrapper:\n    def __init__(self, component):\n        self.c = component\n\n    def wrap(self, wrapped, n):\n"
    "        return wrapped\n\nclass Other:\n    def __init__(self, decorated, n):\n        self.d = decorated",
    "class FastStrategy(Strategy):\n    def set_strategy(self, s):\n        self._strategy = s\n        self.strategy = s\n\n"
    "    def go(self):\n        return self._strategy.run(@K@)\n\n    def gone(self):\n        return self.strategy.run()",
    "# if x > @K@:\n#     return x\n# for y in z:\n#     pass\n# plain words\nx = 1",
    "# note one\n# if a\n# note two\n# def b():\n# class C:\n# return d\n\n# while true\n# let it be",
    '"""Module notes @P@\n\nspanning lines # no comment\nclass Hidden: def nothing(): import never\n"""',
    "url = \"http://host/#part\"  # a comment\nname = 'it\\'s #@K@'\nempty = ''",
    "for i in range(@K@):\n    while i:\n        if i % 2 == 0:\n            i -= 1\n        elif i > 7:\n"
    "            continue\n        else:\n            break\n    else:\n        print(i)",
    "\n\n   \n\t\n",
    "shared_one = load('alpha')\nshared_two = load('beta')\nshared_three = load('gamma')\nshared_four = load('delta')\n"
    "shared_five = load('epsilon')\nshared_six = load('zeta')\nshared_seven = load('eta')",
    "étiquette = \"café @K@\"  # sinon\nélse = if_élan\nnaïve = 3.14 + 42 ** 2",
    "async def fetch_@K@(session):\n    async with session.get(url) as r:\n        return await r.json() if r else None",
    "with open(path) as fh:   \n\tvalue = [\n\t\t1, 2.0, 0x1f,\n\t]\n\tassert value and path or fh",
    "def outer(a):\n    def inner(b):\n        return a + b\n\n    return inner\n\nclass Late:\n    def method(self): return 1",
    "x = y if z else w\nq = a and not b\nlambda v: v is None\nprint('password: none', \"tokens\")",
]

JAVASCRIPT = [
    "import one from 'one'; import two from 'two@K@';\nlet z = 1; import {three} from \"three\"",
    "import fs from 'fs';\nimport { join } from \"path\";\nconst lazy = import('later');",
    "import React from 'react'; // ui\n/* import never from 'x'; */\nimport * as all from './all@K@';",
    "function createThing(a, b) {\n  if (a === b && a || b) {\n    return { a, b };\n  } else if (a > @K@) {\n    return a ? b : null;\n  }\n}",
    "eval(code@K@);\nretrieval();\neval();\ndocument.write('<b>' + name + '</b>');\ndocument.write();",
    "el.innerHTML = html + '@K@';\nel.innerHTML == html;\nel.textContent = html;",
    "const password = 'p@K@';\nlet apiKey = \"k-@P@\";\nvar secret = 'process.env.X';\nconst token = `none`;\nAPI_KEY = 'a'\nlet clientSecret = \"s@K@\", authToken = 't@K@';",
    "console.log('a', @K@);\nconsole.error(e);\nconsole.table(t);\nmyconsole.info(1)",
    "alert('hi');\nif (confirm('sure?')) { prompt(\"n\"); }\nobj.alert(1);\nrealert(2);",
    "if (a == b) { x = 1; }\nif (a != b) { y=2 }\nif (a === b) { z += 3; }\nw = c <= d;",
    "(function () { var hidden = @K@; return hidden; })();\nmodule.exports = { run: 1 };\nexport default {\n  name: 'x'\n};",
    "define(['dep'], function (dep) {\n  return { init: function () { return dep; } };\n});",
    "var Single = (function () { var instance; if (instance) return instance; if (!instance) { instance = {}; } return { getInstance: function () { return instance; } }; })();",
    "class Pool {\n  static getInstance() {\n    return Pool.i;\n  }\n  static createPool(n) {\n    return new Pool(n);\n  }\n}",
    "class WidgetFactory {\n  constructor() {\n    this.n = @K@;\n  }\n}\nThing.prototype.createPart = function () {};\nvar lit = { create: function () {} };",
    "node.addEventListener('click', go);\nnode.removeEventListener(\"click\", go);\nbus.on('x', f);\nbus.emit('x');\nbus.subscribe('t', f);\nbus.publish(\"t\");",
    "function Hub() {\n  this.observers = [];\n  this._observers = [];\n}\nHub.prototype.fire = function (e) { return e; };",
    "Child.prototype = Object.create(Base.prototype);\nconst copy = original.clone();\nnode.clone = function () { return this; };",
    "// if (old) {\n//   return old;\n// }\n// for (const x of y) z();\nlet kept = @K@;",
    "/* block\n * with lines\n */ let after = 1; /* tail */ // end\nconst url = \"http://x//y\"; const re = `tick // ${a}\nsecond`;",
    "const add = (a, b) => {\n  let s = a + b;\n  return s;\n};\nconst mul = (a, b) => a * b;\nvar neg = function (a) {\n  return -a;\n};",
    "for (let i = 0; i < @K@; i++) {\n  while (go) {\n    switch (i) {\n      case 1: break;\n      case 2: continue;\n    }\n  }\n}",
    "try {\n  risky();\n} catch (e) {\n  throw new Error(`bad ${e}`);\n} finally {\n  done();\n}",
    "\n\n  \n\t\n",
    "const sharedOne = load('alpha');\nconst sharedTwo = load('beta');\nconst sharedThree = load('gamma');\n"
    "const sharedFour = load('delta');\nconst sharedFive = load('epsilon');\nconst sharedSix = load('zeta');\nconst sharedSeven = load('eta');",
    "const été = 'à la carte @K@'; // où\nlet ifé = typeof été instanceof String;\ndelete obj.x; void 0;",
    "}}\n{ unbalanced\n}}}\nfunction lost() {\n  deep({ a: { b: 1 } });",
    "export class Service@K@ extends Base {\n  async load(id) {\n    return this.get(id);\n  }\n  static of(x) {\n    return new Service(x);\n  }\n}",
    "export interface Shape@K@ {\n  area(): number;\n}\nexport type Pair<T> = [T, T];\ntype Id = string | number;\nenum Color { Red, Green }",
]

RUST = [
    "use std::fmt;\nuse std::collections::HashMap;",
    "struct Point {\n    x: i32,\n}\n\ntrait Shape {\n    fn area(&self) -> f64;\n}",
    "impl Shape for Point {\n    fn area(&self) -> f64 {\n        if self.x > @K@ { 1.0 } else { 0.0 }\n    }\n}",
    "fn main() {\n    for i in 0..@K@ {\n        match i {\n            0 => println!(\"zero\"),\n            _ => loop { break },\n        }\n    }\n}",
    "// line comment\n/* block */\nlet x = 1; // trailing\n   /* open\n   middle\n   close */",
    "pub fn hidden() {\n    while true {\n        return;\n    }\n}",
    "# if attr\n# for attr\n# let attr\n#[derive(Debug)]\nstruct Late;",
]

DEFINITIONS = [
    "interface Box@K@ {\n  width: number;\n}",
    "type Alias = string;\ntype Broken\nexport type Other = number;",
    "declare function run(a: string): void;\n  method(x: number): void;",
    "// a comment with interface inside\n/* one line */\n/* open\n interface Hidden {}\n\n closed */ type Late = 1;",
    "declare const value: number;\n\n   \nfunction interface type = method(",
    "/** doc */\nexport interface Named extends Base { kind: 'a' }",
]

OTHER = [
    "public class Main {\n    // entry\n    int run(String s) { return s == null ? 0 : @K@; }\n}",
    "func main() {\n\tif x := call(); x > 1 && y {\n\t\tfor i := 0; i < 3; i++ {\n\t\t}\n\t}\n}",
    "/* header\n   text */\nint main(void) { while (1) { switch (x) { case 1: return new_thing; } } }",
    "# hash line\n# if hash\n# for hash\n# class hash\nvalue = \"text @P@\"",
    "String password = \"p@K@\"; // not checked here\neval(x);",
    "const sharedOne = load('alpha');\nconst sharedTwo = load('beta');\nconst sharedThree = load('gamma');\n"
    "const sharedFour = load('delta');\nconst sharedFive = load('epsilon');\nconst sharedSix = load('zeta');\nconst sharedSeven = load('eta');",
]

# Units that long files repeat; @I@ is the number of the repetition.
LONG_PYTHON = ("def long_@K@(rows):", "    total_@I@ = rows[@I@] + @I@\n    if total_@I@ > 3:\n\n        total_@I@ -= 1\n    # step @I@\n    log(total_@I@)")
LONG_METHODS = ("class Big@K@(Base):", "    def method_@I@(self, value):\n        return value + @I@\n\n    limit_@I@ = @I@")
LONG_JS = ("const long@K@ = (rows) => {", "  const total@I@ = rows[@I@];\n  if (total@I@ > 3) {\n    log(total@I@); }\n\n  // step @I@")
LONG_OBJECT = ("var table = { first: function (a) {", "  key@I@: function (b) {\n    return b + @I@;\n  },\n  function named@I@(c) {\n    if (c) { return; }\n  }")
LONG_DEFINITION = ("declare module 'm@K@' {", "  interface I@I@ {\n    id: number;\n  }\n  // note @I@\n  type T@I@ = string;\n  function f@I@(a: number): void;\n\n"
                   "  /* several\n     lines */\n  const c@I@: number;\n  const d@I@: number;\n  const e@I@: number;\n  const g@I@: number;\n  const h@I@: number;\n  const i@I@: number;\n  const j@I@: number;\n"
                   "  const k@I@: number;\n  const l@I@: number;\n  const m@I@: number;\n  const n@I@: number;\n  const o@I@: number;\n  const p@I@: number;\n  const q@I@: number;\n  const r@I@: number;")
LONG_REPEAT = ("package main", "repeated line number one of the block\nrepeated line number two\nrepeated line number three\nrepeated four")
