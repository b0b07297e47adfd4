"""orderkeep.functions"""
