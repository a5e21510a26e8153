"""python -m treegate.demo: checks one record against one grammar."""

from treegate import parse
from treegate.sources import jsontree

if __name__ == "__main__":
    grammar = parse(".DragonsExist == true")
    print("valid" if grammar.accepts(jsontree.decode('{"DragonsExist": false}')) else "dragons don't exist")
