"""Tables, stored models and exports."""
