"""Column functions: Column in, Column out, all evaluated by Catalyst unless a module says otherwise."""
