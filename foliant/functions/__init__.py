"""foliant.functions"""
